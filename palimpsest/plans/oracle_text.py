"""DuckDB statements of the text jobs, used only to check the Spark results."""

from __future__ import annotations

from palimpsest.functions.text import (
    CJK_CHARACTER,
    FORMAT_ONLY,
    LEVEL_PATTERNS,
    WORD_CHARACTER,
)
from palimpsest.operators.reconcile import LEVELS
from palimpsest.plans.recipes_text import transcripts_sql

POWERS = "[" + ",".join(str(1 << p) for p in range(30, -1, -1)) + "]"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c for c in ctes if c) + "\n"


def gaps_sql(out: str, source: str, sides: list[tuple[str, str]], levels=LEVELS) -> str:
    """CTEs that end in `out` (doc_id, {side}_start, {side}_end, {side}_text)."""
    names = [s for s, _ in sides]
    first, rest = names[0], names[1:]

    def differ(prefix: str = "") -> str:
        return "NOT (" + " AND ".join(
            f"{prefix}{first}_text = {prefix}{s}_text" for s in rest
        ) + ")"

    ctes = [
        f"{out}_0 AS (SELECT doc_id, "
        + ", ".join(f"CAST(0 AS BIGINT) AS {s}_at, {c} AS {s}_text" for s, c in sides)
        + f" FROM {source} WHERE NOT ("
        + " AND ".join(f"{sides[0][1]} = {c}" for _, c in sides[1:])
        + "))"
    ]
    keys = "doc_id, " + ", ".join(f"{s}_at" for s in names)
    for n, level in enumerate(levels):
        src, pattern = f"{out}_{n}", LEVEL_PATTERNS[level]
        words = " UNION ALL ".join(
            f"SELECT {keys}, {i} AS side, "
            f"unnest(list_append(regexp_extract_all({s}_text, '{pattern}'), '')) AS token, "
            f"generate_subscripts(list_append(regexp_extract_all({s}_text, '{pattern}'), ''), 1)"
            f" AS idx FROM {src}"
            for i, s in enumerate(names)
        )
        ctes.append(f"{src}_w AS ({words})")
        ctes.append(
            f"{src}_p AS (SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY {keys}, side "
            f"ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos "
            f"FROM {src}_w)"
        )
        ctes.append(
            f"{src}_u AS (SELECT {keys}, token, "
            + ", ".join(f"max(pos) FILTER (side = {i}) AS {s}_pos" for i, s in enumerate(names))
            + f" FROM {src}_p GROUP BY {keys}, token HAVING count(*) = {len(names)} "
            f"AND count(DISTINCT side) = {len(names)})"
        )
        ctes.append(
            f"{src}_k AS (SELECT * FROM {src}_u QUALIFY "
            + " AND ".join(
                f"coalesce(max({s}_pos) OVER (PARTITION BY {keys} ORDER BY {first}_pos "
                f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < {s}_pos AND "
                f"coalesce(min({s}_pos) OVER (PARTITION BY {keys} ORDER BY {first}_pos DESC "
                f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e18) > {s}_pos"
                for s in rest
            )
            + ")"
        )
        ctes.append(
            f"{src}_m AS (SELECT {keys}, "
            + ", ".join(
                f"{s}_pos, lag({s}_pos + length(token), 1, 0) OVER (PARTITION BY {keys} "
                f"ORDER BY {first}_pos) AS {s}_from"
                for s in names
            )
            + f" FROM {src}_k)"
        )
        ctes.append(
            f"{out}_{n + 1} AS (SELECT * FROM (SELECT g.doc_id, "
            + ", ".join(
                f"CAST(g.{s}_at + {s}_from AS BIGINT) AS {s}_at, "
                f"substr({s}_text, CAST({s}_from + 1 AS BIGINT), "
                f"CAST({s}_pos - {s}_from AS BIGINT)) AS {s}_text"
                for s in names
            )
            + f" FROM {src} g JOIN {src}_m m ON "
            + " AND ".join(f"g.{k} = m.{k}" for k in keys.split(", "))
            + f") WHERE {differ()})"
        )
    last = f"{out}_{len(levels)}"
    limit = "least(" + ", ".join(f"length({s}_text)" for s in names) + ")"
    head = " AND ".join(
        f"substr({first}_text, acc + 1, st) = substr({s}_text, acc + 1, st)" for s in rest
    )
    tail = " AND ".join(
        f"substr({first}_text, length({first}_text) - acc - st + 1, st) = "
        f"substr({s}_text, length({s}_text) - acc - st + 1, st)"
        for s in rest
    )
    ctes.append(
        f"{out}_h AS (SELECT *, list_reduce({POWERS}, lambda acc, st: CASE WHEN acc + st <= "
        f"{limit} AND {head} THEN acc + st ELSE acc END, 0) AS head FROM {last})"
    )
    ctes.append(
        f"{out}_t AS (SELECT *, list_reduce({POWERS}, lambda acc, st: CASE WHEN acc + st <= "
        f"{limit} - head AND {tail} THEN acc + st ELSE acc END, 0) AS tail FROM {out}_h)"
    )
    ctes.append(
        f"{out} AS (SELECT doc_id, "
        + ", ".join(
            f"CAST({s}_at + head AS BIGINT) AS {s}_start, "
            f"CAST({s}_at + length({s}_text) - tail AS BIGINT) AS {s}_end, "
            f"substr({s}_text, head + 1, length({s}_text) - head - tail) AS {s}_text"
            for s in names
        )
        + f" FROM {out}_t)"
    )
    return ",\n".join(ctes)


def components_sql() -> str:
    gaps = gaps_sql("gap3", "transcripts", [("base", "base"), ("a", "a"), ("b", "b")])
    return gaps + """,
components AS (
  SELECT doc_id, base_start AS start_, base_end AS end_, base_text AS original,
         a_start, a_end, a_text, b_start, b_end, b_text,
         CASE WHEN a_text = b_text THEN 'agreement'
              WHEN a_text = base_text OR b_text = base_text THEN 'singleton'
              ELSE 'conflict' END AS state,
         CASE WHEN a_text = b_text OR b_text = base_text THEN a_text
              WHEN a_text = base_text THEN b_text ELSE base_text END AS merged
  FROM gap3)"""


def rebuilt_sql(out: str, edits: str, texts: str = "transcripts", name: str = "preview") -> str:
    """`edits` has doc_id, start_, end_, replacement."""
    return f"""{out} AS (
  SELECT t.doc_id, coalesce(e.head || substr(t.base, e.last_end + 1), t.base) AS {name}
  FROM {texts} t LEFT JOIN (
    SELECT doc_id, max(end_) AS last_end,
           string_agg(kept || replacement, '' ORDER BY start_, end_) AS head
    FROM (SELECT x.doc_id, start_, end_, replacement,
                 substr(t.base, prior + 1, start_ - prior) AS kept
          FROM (SELECT *, lag(end_, 1, 0) OVER (PARTITION BY doc_id ORDER BY start_, end_)
                       AS prior FROM {edits}) x JOIN {texts} t ON t.doc_id = x.doc_id)
    GROUP BY doc_id) e ON e.doc_id = t.doc_id)"""


def hunks_sql(out: str, variant: str) -> str:
    gaps = gaps_sql(f"g_{out}", "transcripts", [("base", "base"), ("variant", variant)])
    return gaps + f""",
{out} AS (SELECT doc_id, base_start AS start_, base_end AS end_, variant_start, variant_end,
                 base_text AS original, variant_text AS replacement FROM g_{out})"""


def boundary_sql(out: str, positions: str, hunks: str, keys: str = "doc_id", carry: str = ""):
    """Maps `positions` (keys, position, carry) by asking each hunk list in order."""
    extra = f", {carry}" if carry else ""
    blanks = "".join(f", NULL AS {c.strip()}" for c in carry.split(",")) if carry else ""
    return f"""{out}_u AS (
  SELECT {keys}, CAST(position AS BIGINT) AS at_, 1 AS rank_,
         CAST(NULL AS STRUCT(s BIGINT, e BIGINT, vs BIGINT, ve BIGINT)) AS h{extra}
  FROM {positions}
  UNION ALL
  SELECT {keys}, start_, CASE WHEN start_ = end_ THEN 0 ELSE 2 END,
         {{'s': start_, 'e': end_, 'vs': variant_start, 've': variant_end}}{blanks} FROM {hunks}),
{out}_l AS (SELECT {keys}, at_ AS p, rank_{extra}, last_value(h IGNORE NULLS) OVER (
  PARTITION BY {keys} ORDER BY at_, rank_ ROWS UNBOUNDED PRECEDING) AS h FROM {out}_u),
{out} AS (
  SELECT {keys}, p AS position{extra},
    CASE WHEN h IS NULL THEN p WHEN h.s = p THEN h.vs WHEN h.e > p THEN NULL
         ELSE p + h.ve - h.e END AS mapped,
    CASE WHEN h IS NULL THEN p WHEN h.s < p AND h.e > p THEN NULL WHEN h.s = p AND h.e > p
         THEN h.vs ELSE p + h.ve - h.e END AS mapped_after_insert,
    CASE WHEN h.s < p AND h.e > p THEN h.s ELSE p END AS left_edge,
    CASE WHEN h.s < p AND h.e > p THEN h.vs WHEN h.s = p THEN h.vs
         ELSE p + coalesce(h.ve - h.e, 0) END AS left_image,
    CASE WHEN h.s < p AND h.e > p THEN h.e ELSE p END AS right_edge,
    CASE WHEN h.s < p AND h.e > p THEN h.ve ELSE p + coalesce(h.ve - h.e, 0) END AS right_image
  FROM {out}_l WHERE rank_ = 1)"""


def framed_sql(*fields: str) -> str:
    return "(" + " || ".join(
        f"coalesce(length(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')"
        for f in fields
    ) + ")"


def id_sql(prefix: str, *fields: str, size: int = 64) -> str:
    return f"'{prefix}' || substr(sha256({framed_sql(*fields)}), 1, {size})"


def category_sql(base: str, variant: str) -> str:
    """CASE over alias h (hunk columns) joined with t (texts)."""

    def joining(ch: str) -> str:
        return (
            f"coalesce(regexp_matches({ch}, '{WORD_CHARACTER}') AND NOT "
            f"regexp_matches({ch}, '{CJK_CHARACTER}'), false)"
        )

    def joins(fragment: str, text: str, start: str, end: str) -> str:
        left = f"CASE WHEN {start} > 0 THEN substr({text}, {start}, 1) END"
        right = f"CASE WHEN {end} < length({text}) THEN substr({text}, {end} + 1, 1) END"
        return (
            f"({joining(f'({right})')} AND (ends_with({fragment}, '.') "
            f"OR {joining(f'({left})')}))"
        )

    return (
        f"CASE WHEN regexp_matches(h.original || h.replacement, '{FORMAT_ONLY}') AND NOT "
        f"{joins('h.original', f't.{base}', 'h.start_', 'h.end_')} AND NOT "
        f"{joins('h.replacement', f't.{variant}', 'h.variant_start', 'h.variant_end')} "
        "THEN 'prosodic_format_only' ELSE 'lexical' END"
    )


TEXTS = transcripts_sql()
