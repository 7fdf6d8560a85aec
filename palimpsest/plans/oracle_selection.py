"""DuckDB statements of the conflict, batch and review jobs."""

from __future__ import annotations

from palimpsest.operators.selection import (
    CASE_FIELDS,
    CONTEXT_CHARS,
    CONTEXT_STOPS,
    MAX_CASES,
    MAX_CONTEXT_CHARS,
    MAX_INPUT_BYTES,
    ORDER_TAG,
)
from palimpsest.plans.oracle_text import (
    TEXTS,
    boundary_sql,
    components_sql,
    framed_sql,
    gaps_sql,
    hunks_sql,
    id_sql,
    rebuilt_sql,
    with_,
)

__all__ = ["TEXTS", "components_sql", "gaps_sql", "hunks_sql", "rebuilt_sql", "with_"]

_FIELDS = [{"start": "start_", "end": "end_"}.get(c, c) for c in CASE_FIELDS]

CASES = ",\n".join([
    components_sql(),
    hunks_sql("peer_h", "peer"),
    """edges AS (
  SELECT doc_id, start_ AS cs, end_ AS ce, 0 AS edge, start_ AS position
  FROM components WHERE state = 'conflict'
  UNION ALL SELECT doc_id, start_, end_, 1, end_ FROM components WHERE state = 'conflict')""",
    boundary_sql("pm", "edges", "peer_h", carry="cs, ce, edge"),
    f"""peer_w AS (
  SELECT doc_id, cs, ce, max(mapped) FILTER (edge = 0) AS ps, max(mapped) FILTER (edge = 1) AS pe,
         max(mapped_after_insert) FILTER (edge = 1) AS pa FROM pm GROUP BY doc_id, cs, ce),
cases_0 AS (
  SELECT c.*, t.base, t.peer, p.ps,
         CASE WHEN end_ = length(base) OR start_ = end_ THEN pa ELSE pe END AS pr,
         greatest(start_ - {CONTEXT_CHARS}, 0) AS near_l,
         greatest(start_ - {MAX_CONTEXT_CHARS}, 0) AS far_l,
         least(end_ + {CONTEXT_CHARS}, length(base)) AS near_r,
         least(end_ + {MAX_CONTEXT_CHARS}, length(base)) AS far_r
  FROM components c JOIN peer_w p ON p.doc_id = c.doc_id AND p.cs = c.start_ AND p.ce = c.end_
  JOIN transcripts t ON t.doc_id = c.doc_id WHERE state = 'conflict'),
cases_1 AS (
  SELECT doc_id, start_, end_, original, a_start, a_end, a_text, b_start, b_end, b_text,
         CASE WHEN pr IS NOT NULL THEN ps END AS peer_start,
         CASE WHEN ps IS NOT NULL THEN pr END AS peer_end,
         CASE WHEN ps IS NOT NULL AND pr IS NOT NULL THEN substr(peer, ps + 1, pr - ps) END
           AS peer_text,
         near_l - length(regexp_extract(substr(base, far_l + 1, near_l - far_l),
           '[^{CONTEXT_STOPS}]*\\z')) AS context_left,
         least(near_r + length(regexp_extract(
           substr(base, greatest(near_r - 1, 0) + 1, far_r - greatest(near_r - 1, 0)),
           '\\A[^{CONTEXT_STOPS}]*')), far_r) AS context_right
  FROM cases_0),
cases AS (SELECT *, {id_sql('case_', *_FIELDS, size=24)} AS case_id FROM cases_1),
src AS (
  SELECT doc_id, case_id, original, 'base' AS source, original AS text, start_ AS f, end_ AS t,
         context_left, context_right FROM cases
  UNION ALL SELECT doc_id, case_id, original, 'a', a_text, a_start, a_end, context_left,
    context_right FROM cases
  UNION ALL SELECT doc_id, case_id, original, 'b', b_text, b_start, b_end, context_left,
    context_right FROM cases
  UNION ALL SELECT doc_id, case_id, original, 'peer', peer_text, peer_start, peer_end,
    context_left, context_right FROM cases WHERE peer_text IS NOT NULL),
cand AS (
  SELECT doc_id, case_id, text, list_sort(list(source)) AS sources,
         bool_or(text = original) AS is_keep,
         'c' || row_number() OVER (PARTITION BY doc_id, case_id ORDER BY
           sha256({framed_sql('case_id', 'text', f"'{ORDER_TAG}'")}), text) AS candidate_id
  FROM src GROUP BY doc_id, case_id, text)""",
])

CONTEXTS = ",\n".join([
    """ctx_in AS (
  SELECT doc_id, source, case_id, f, t, 0 AS edge, context_left AS position FROM src
  UNION ALL SELECT doc_id, source, case_id, f, t, 1, context_right FROM src),
h3 AS (
  SELECT doc_id, 'a' AS source, start_, end_, a_start AS variant_start, a_end AS variant_end
  FROM components
  UNION ALL SELECT doc_id, 'b', start_, end_, b_start, b_end FROM components
  UNION ALL SELECT doc_id, 'peer', start_, end_, variant_start, variant_end FROM peer_h)""",
    boundary_sql("cm", "ctx_in", "h3", keys="doc_id, source", carry="case_id, f, t, edge"),
    """ctx AS (
  SELECT x.*, substr(body, context_start + 1, f - context_start) AS before,
         substr(body, f + 1, t - f) AS target,
         substr(body, t + 1, context_end - t) AS after
  FROM (
    SELECT m.doc_id, m.source, m.case_id, m.f, m.t, context_start, context_end,
           CASE m.source WHEN 'base' THEN base WHEN 'a' THEN a WHEN 'b' THEN b ELSE peer END
             AS body
    FROM (SELECT doc_id, source, case_id, f, t,
                 max(left_image) FILTER (edge = 0) AS context_start,
                 max(right_image) FILTER (edge = 1) AS context_end
          FROM cm GROUP BY doc_id, source, case_id, f, t) m
    JOIN transcripts x ON x.doc_id = m.doc_id) x)""",
])


def full_sql() -> str:
    order = f"sha256({framed_sql('x.case_id', 'x.source')})"
    return f"""versions AS (
  SELECT x.doc_id, x.case_id, x.source, x.f, x.t, x.context_start, x.context_end,
         x.before, x.target, x.after, c.candidate_id,
         row_number() OVER (PARTITION BY x.doc_id, x.case_id ORDER BY {order}) AS vn
  FROM ctx x JOIN cand c ON c.doc_id = x.doc_id AND c.case_id = x.case_id
    AND c.text = x.target),
vlist AS (
  SELECT doc_id, case_id, list({{'version_id': 'v' || vn, 'candidate_id': candidate_id,
    'before': before, 'target': target, 'after': after}} ORDER BY vn) AS versions
  FROM versions GROUP BY doc_id, case_id),
clist AS (
  SELECT doc_id, case_id,
    list({{'candidate_id': candidate_id, 'text': text}} ORDER BY candidate_id) AS candidates,
    max(candidate_id) FILTER (is_keep) AS keep_candidate_id, count(*) AS options
  FROM cand GROUP BY doc_id, case_id),
full_cases AS (
  SELECT k.*, c.keep_candidate_id, c.options, strlen(CAST(to_json({{'case_id': k.case_id,
    'candidates': c.candidates, 'versions': v.versions,
    'keep_candidate_id': c.keep_candidate_id}}) AS VARCHAR)) AS bytes
  FROM cases k JOIN clist c ON c.doc_id = k.doc_id AND c.case_id = k.case_id
  JOIN vlist v ON v.doc_id = k.doc_id AND v.case_id = k.case_id)"""


def pack_sql(max_cases: int = MAX_CASES, max_bytes: int = MAX_INPUT_BYTES) -> str:
    too_big = f"n.bytes + 12 > {max_bytes}"
    starts = (
        f"(p.used = 0 OR p.used = {max_cases} OR p.size + 1 + n.bytes + 12 > {max_bytes})"
    )
    return f"""num AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_, end_) AS rn FROM full_cases),
slim AS MATERIALIZED (SELECT doc_id, rn, bytes FROM num),
pack AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS rn, 0 AS batch, 0 AS used,
         CAST(0 AS BIGINT) AS size, CAST(NULL AS INTEGER) AS batch_no FROM slim
  UNION ALL
  SELECT n.doc_id, n.rn,
         CASE WHEN {too_big} THEN p.batch WHEN {starts} THEN p.batch + 1 ELSE p.batch END,
         CASE WHEN {too_big} THEN p.used WHEN {starts} THEN 1 ELSE p.used + 1 END,
         CASE WHEN {too_big} THEN p.size WHEN {starts} THEN n.bytes
              ELSE p.size + 1 + n.bytes END,
         CASE WHEN {too_big} THEN NULL WHEN {starts} THEN p.batch + 1 ELSE p.batch END
  FROM pack p JOIN slim n ON n.doc_id = p.doc_id AND n.rn = p.rn + 1),
placed AS (SELECT n.*, p.batch_no FROM num n JOIN pack p ON p.doc_id = n.doc_id AND p.rn = n.rn),
named AS (
  SELECT doc_id, batch_no,
         {id_sql('batch_', 'doc_id', "string_agg(case_id, ',' ORDER BY start_, end_)", size=24)}
           AS batch_id
  FROM placed WHERE batch_no IS NOT NULL GROUP BY doc_id, batch_no),
batched AS (
  SELECT p.*, m.batch_id, CASE WHEN p.batch_no IS NOT NULL THEN row_number() OVER (
           PARTITION BY p.doc_id, p.batch_no ORDER BY start_, end_) END AS place
  FROM placed p LEFT JOIN named m ON m.doc_id = p.doc_id AND m.batch_no = p.batch_no)"""


# The decisions recipe: batches whose id starts with 0..3 each break one rule.
DECISIONS = """decisions AS (
  SELECT doc_id, batch_id,
         CASE WHEN substr(batch_id, 7, 1) = '3' AND place = 1 THEN 'case_unknown'
              ELSE case_id END AS case_id,
         CASE WHEN substr(batch_id, 7, 1) = '1' AND place = 1 THEN 'c9' ELSE 'c1' END
           AS candidate_id
  FROM batched WHERE batch_id IS NOT NULL
    AND NOT (substr(batch_id, 7, 1) = '0' AND place = 1)
  UNION ALL
  SELECT doc_id, batch_id, case_id, 'c1' FROM batched
  WHERE substr(batch_id, 7, 1) = '2' AND place = 1)"""

COVERAGE = """usage AS (
  SELECT doc_id, batch_id, case_id, count(*) AS uses,
         list(DISTINCT candidate_id) AS chosen FROM decisions GROUP BY doc_id, batch_id, case_id),
wanted AS (SELECT doc_id, batch_id, case_id, options FROM batched WHERE batch_id IS NOT NULL),
coverage_0 AS (
  SELECT coalesce(w.doc_id, u.doc_id) AS doc_id, coalesce(w.batch_id, u.batch_id) AS batch_id,
         w.case_id IS NOT NULL AS known, coalesce(u.uses, 0) AS uses,
         coalesce(len(list_filter(u.chosen, lambda c: CAST(substr(c, 2) AS INT) > w.options)), 0)
           > 0 AS stranger
  FROM wanted w FULL OUTER JOIN usage u
    ON u.doc_id = w.doc_id AND u.batch_id = w.batch_id AND u.case_id = w.case_id),
coverage_1 AS (
  SELECT doc_id, batch_id, count(*) FILTER (known) AS cases, sum(uses) AS decisions,
         count(*) FILTER (known AND uses = 0) AS missing,
         count(*) FILTER (uses > 1) AS duplicated,
         count(*) FILTER (NOT known) AS unknown_case,
         count(*) FILTER (known AND uses > 0 AND stranger) AS unknown_candidate
  FROM coverage_0 GROUP BY doc_id, batch_id),
coverage AS (
  SELECT *, missing + duplicated + unknown_case + unknown_candidate = 0 AS valid FROM coverage_1)"""

SELECTED = """selected AS (
  SELECT d.doc_id, b.start_, b.end_, b.original, c.text AS replacement,
         'selection' AS resolution, d.case_id, d.candidate_id
  FROM decisions d
  JOIN coverage v ON v.doc_id = d.doc_id AND v.batch_id = d.batch_id AND v.valid
  JOIN batched b ON b.doc_id = d.doc_id AND b.batch_id = d.batch_id AND b.case_id = d.case_id
  JOIN cand c ON c.doc_id = d.doc_id AND c.case_id = d.case_id
    AND c.candidate_id = d.candidate_id)"""

REVIEWS = f"""items AS (
  SELECT b.*, CASE WHEN b.batch_id IS NULL THEN 'selection_input_budget_exceeded'
              ELSE 'selection_unavailable' END AS reason, 'rev_' || b.case_id AS review_id
  FROM batched b LEFT JOIN coverage v ON v.doc_id = b.doc_id AND v.batch_id = b.batch_id
  WHERE b.batch_id IS NULL OR NOT v.valid),
queues AS (
  SELECT t.doc_id, coalesce(n, 0) AS items,
         CASE WHEN n IS NULL THEN 'clear' ELSE 'needs_review' END AS status,
         {id_sql('queue_', 't.doc_id', "coalesce(ids, '')", size=24)} AS queue_id
  FROM transcripts t LEFT JOIN (
    SELECT doc_id, count(*) AS n, string_agg(review_id, ',' ORDER BY review_id) AS ids
    FROM items GROUP BY doc_id) q ON q.doc_id = t.doc_id),
resolved AS (
  SELECT doc_id, start_, end_, merged AS replacement FROM components WHERE state <> 'conflict'
  UNION ALL SELECT doc_id, start_, end_, replacement FROM selected)"""

# The human decisions recipe: the action follows the review id; some documents break a rule.
HUMAN = """human_0 AS (
  SELECT doc_id, review_id, place, start_, substr(review_id, 10, 1) AS d,
         row_number() OVER (PARTITION BY doc_id ORDER BY start_, end_) AS n FROM items),
human AS (
  SELECT h.doc_id,
         CASE WHEN h.doc_id % 9 = 1 THEN 'queue_old' ELSE q.queue_id END AS queue_id, review_id,
         CASE WHEN h.doc_id % 9 = 3 AND n = 1 THEN 'erase'
              WHEN d < '3' THEN 'keep' WHEN d < '6' THEN 'a' WHEN d < '9' THEN 'b'
              WHEN d < 'c' THEN 'peer' ELSE 'replace' END AS action,
         CASE WHEN d >= 'c' THEN 'typed by hand' END AS replacement
  FROM human_0 h JOIN queues q ON q.doc_id = h.doc_id
  WHERE NOT (h.doc_id % 9 = 2 AND n = 1))"""

RESOLUTION = ",\n".join([
    """matched AS (
  SELECT coalesce(i.doc_id, g.doc_id) AS doc_id, i.start_, i.end_, i.review_id IS NOT NULL AS known,
         g.uses, g.action, CASE g.action WHEN 'keep' THEN i.original WHEN 'a' THEN i.a_text
         WHEN 'b' THEN i.b_text WHEN 'peer' THEN i.peer_text WHEN 'replace' THEN g.replacement END
         AS chosen
  FROM items i FULL OUTER JOIN (
    SELECT doc_id, review_id, count(*) AS uses, max(action) AS action,
           max(replacement) AS replacement FROM human GROUP BY doc_id, review_id) g
  ON g.doc_id = i.doc_id AND g.review_id = i.review_id),
verdict AS (
  SELECT q.doc_id, CASE WHEN s.stale THEN 'stale_queue' WHEN m.uncovered THEN 'coverage'
         WHEN m.bad_action THEN 'unknown_action' WHEN m.absent THEN 'unavailable_candidate'
         ELSE 'resolved' END AS outcome
  FROM queues q LEFT JOIN (
    SELECT doc_id, bool_or(NOT known OR uses IS NULL OR uses > 1) AS uncovered,
           bool_or(action NOT IN ('keep', 'a', 'b', 'peer', 'replace')) AS bad_action,
           bool_or(action IN ('keep', 'a', 'b', 'peer', 'replace') AND chosen IS NULL) AS absent
    FROM matched GROUP BY doc_id) m ON m.doc_id = q.doc_id
  LEFT JOIN (SELECT h.doc_id, bool_or(h.queue_id <> q.queue_id) AS stale
             FROM human h JOIN queues q ON q.doc_id = h.doc_id GROUP BY h.doc_id) s
    ON s.doc_id = q.doc_id
  WHERE q.status = 'needs_review'),
final_edits AS (
  SELECT r.* FROM resolved r JOIN verdict v ON v.doc_id = r.doc_id AND v.outcome = 'resolved'
  UNION ALL
  SELECT m.doc_id, m.start_, m.end_, m.chosen FROM matched m
  JOIN verdict v ON v.doc_id = m.doc_id AND v.outcome = 'resolved' WHERE m.action <> 'keep')""",
    rebuilt_sql("final_text", "final_edits", name="text"),
])

# The patch recipe: three residues of doc_id break one rule each.
PATCHES = """patches AS (
  SELECT doc_id, start_, CASE WHEN doc_id % 11 = 2 THEN end_ + 100000 ELSE end_ END AS end_,
         CASE WHEN doc_id % 11 = 1 THEN original || '!' ELSE original END AS original,
         merged AS replacement FROM components
  UNION ALL SELECT doc_id, start_, end_, original, merged FROM components WHERE doc_id % 11 = 3),
patch_flags AS (
  SELECT p.doc_id,
         bool_or(start_ < 0 OR start_ > end_ OR end_ > length(base)) AS outside,
         bool_or(coalesce(end_ > nxt OR start_ = nxt, false)) AS clash,
         bool_or(substr(base, start_ + 1, end_ - start_) <> original) AS stale
  FROM (SELECT *, lead(start_) OVER (PARTITION BY doc_id ORDER BY start_, end_) AS nxt
        FROM patches) p JOIN transcripts t ON t.doc_id = p.doc_id GROUP BY p.doc_id),
patch_verdict AS (
  SELECT doc_id, CASE WHEN outside THEN 'out_of_range' WHEN clash THEN 'overlap'
         WHEN stale THEN 'stale_original' END AS reason FROM patch_flags),
good_patches AS (
  SELECT p.doc_id, start_, end_, replacement FROM patches p
  JOIN patch_verdict v ON v.doc_id = p.doc_id WHERE reason IS NULL)"""
