"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# White space as in the operators: U+0020 and U+0009 to U+000D.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RUN = r"'[\x20\x09-\x0D]+'"


def _normal(c: str) -> str:
    return f"regexp_replace(trim({c}, {_BLANKS}), {_RUN}, ' ', 'g')"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op1_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g
        FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
own AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT r, own.n, k, item FROM own JOIN win ON own.n = win.n AND own.g = win.g),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(names, '')) AS items_sha256 FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r))
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM m
"""

ORACLES["op10_repeats"] = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS g FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d)),
hit AS (SELECT r, p FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
run AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k
        FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM hit)),
span AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM run GROUP BY r, k),
gap AS (SELECT r, a AS till, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM span
        UNION ALL SELECT d.r, length(h) // 2, coalesce(max(b), 0) FROM d LEFT JOIN span ON d.r = span.r GROUP BY d.r, h),
kept AS (SELECT gap.r, string_agg(substr(h, 2 * since + 1, 2 * (till - since)), '' ORDER BY since) AS k FROM gap JOIN d ON gap.r = d.r GROUP BY gap.r),
n AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (r) LEFT JOIN n USING (r)
"""

ORACLES["op4_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text IS NULL AS none, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(w[k:k + 4], ' ') AS s
       FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE NOT none)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
both_in AS (SELECT x.r AS u, y.r AS v, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r),
link AS (SELECT u, v FROM both_in JOIN n a ON u = a.r JOIN n b ON v = b.r WHERE c >= 0.8 * (a.n + b.n - c)),
reach AS (SELECT r AS u, r AS v FROM d UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
class AS (SELECT u AS r, min(v) AS c FROM reach GROUP BY u),
size AS (SELECT c, count(*) AS in_class FROM class GROUP BY c)
SELECT d.doc_id, e.doc_id AS class_id, in_class, d.r = e.r AS kept
FROM d JOIN class ON d.r = class.r JOIN size ON class.c = size.c JOIN d e ON class.c = e.r
"""

ORACLES["op3_line_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, * FROM documents),
split AS (SELECT r, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM docs),
lines AS (SELECT r, coalesce(source, chr(0) || 'null') AS site, pos, ls[pos] AS raw, {_normal('ls[pos]')} AS line
          FROM (SELECT r, source, ls, unnest(range(1, len(ls) + 1)) AS pos FROM split)),
spread AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 8),
marked AS (SELECT l.*, s.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY r, pos) > 1 AS gone
           FROM lines l LEFT JOIN spread s ON l.line = s.line),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed_lines,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_removed_lines, sha256(k.text) AS kept_sha256
FROM docs d JOIN kept k ON d.r = k.r
"""

ORACLES["op9_quality_rules"] = f"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS text,
              coalesce(source, chr(0) || 'null') AS host FROM documents),
ws AS (SELECT r, list_filter(string_split_regex(text, {_RUN}), lambda x: x <> '') AS w FROM docs),
win AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM ws)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
lines AS (SELECT r, host, l, {_normal('l')} AS line FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS l FROM docs)),
wordy AS (SELECT *, len(string_split(line, ' ')) AS words FROM lines WHERE line <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM wordy GROUP BY r),
above AS (SELECT host, line FROM wordy JOIN (SELECT host, count(*) AS docs FROM docs GROUP BY host) USING (host)
          GROUP BY host, line, docs HAVING count(DISTINCT r) > 20 AND count(DISTINCT r) * 1000 > docs * 5),
gone AS (SELECT r, sum(words) AS n_removed_words FROM wordy JOIN above USING (host, line) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words,
      length(regexp_replace(text, {_RUN}, '', 'g')) AS word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
      FROM docs JOIN ws USING (r) LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 10
          AND 100 * (n_words - n_removed_words) >= 50 * n_words AS kept FROM f
"""


_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op12_search"] = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {_TERMS} AS w FROM documents),
own AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM own),
tfs AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM own) GROUP BY r, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2.0 * nd + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY t, nd),
i AS (SELECT row_number() OVER (ORDER BY item_id) AS q, item_id, {_TERMS} AS w FROM benchmark),
terms AS (SELECT DISTINCT q, item_id, unnest(w) AS t FROM i),
score AS (SELECT q, item_id, own.r, doc_id,
          CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt)))) AS BIGINT) AS score
          FROM terms JOIN tfs USING (t) JOIN weight USING (t) JOIN own ON own.r = tfs.r, total GROUP BY q, item_id, own.r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """Levels ``name0``... of (g, i, h, n), each with what stands before and after a node in its run."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        low = f"{name}{k}"
        out.append(
            f"{low}s AS (SELECT a.g, a.i, a.h, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, "
            f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after "
            f"FROM {low} a JOIN {low} b ON a.g = b.g AND a.i // 16 = b.i // 16 GROUP BY a.g, a.i, a.h, a.n)"
        )
        out.append(
            f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, "
            f"(n + 15) // 16 AS n FROM {low} GROUP BY g, i // 16, n)"
        )
    return ",\n".join(out)


def _climb(name: str, start: str, levels: int) -> str:
    """``name0``... of (r, g, i, fold, proof): from each row up the levels of a tree, one at a time."""
    tree = name[1:]
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(
            f"{name}{k + 1} AS (SELECT r, c.g, c.i // 16 AS i, CASE WHEN n = 1 THEN fold ELSE sha256(before || fold || after) END AS fold, "
            f"proof || before || after AS proof FROM {name}{k} c JOIN {tree}{k}s s ON c.g = s.g AND c.i = s.i)"
        )
    return ",\n".join(out)


def _manifest(levels: int = 5) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in (*fields, text)) + ")"

    # DuckDB has no crc32; it is eight steps of shift and exclusive or for each digit of the id.
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = (
        "crc AS (SELECT CAST(4294967295 AS BIGINT) AS c, 0 AS k, r, CAST(doc_id AS VARCHAR) AS s, 8 AS b FROM d UNION ALL "
        f"SELECT CASE WHEN b = 8 THEN xor(c, ascii(s[k + 1])) ELSE {step} END, CASE WHEN b = 7 THEN k + 1 ELSE k END, r, s, CASE WHEN b = 8 THEN 0 WHEN b = 7 THEN 8 ELSE b + 1 END "
        "FROM crc WHERE k < length(s))"
    )
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, *, {leaf("text")} AS leaf,
           {leaf(f"translate(text, '{upper}', '{lower}')")} AS other, coalesce('s' || source, '') AS g FROM documents),
{crc},
bad AS (SELECT r, xor(c, 4294967295) % 5 = 0 AS bad FROM crc WHERE k = length(s) AND b = 8),
p AS (SELECT r, g, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree("t", "SELECT g, i, leaf AS h, n FROM p", levels)},
top AS (SELECT g, min(h) AS h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t{levels} GROUP BY g),
{_tree("u", "SELECT 0 AS g, i, h, n FROM top", levels)},
{_climb("ct", "SELECT p.r, p.g, i, CASE WHEN bad THEN other ELSE p.leaf END AS fold, '' AS proof FROM p JOIN d ON p.r = d.r LEFT JOIN bad ON bad.r = d.r", levels)},
{_climb("cu", f"SELECT r, 0 AS g, top.i, fold, proof FROM ct{levels} c JOIN top ON c.g = top.g", levels)}
SELECT doc_id, leaf, top.h AS subroot, u{levels}.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u{levels}.h AS verified
FROM d JOIN top ON d.g = top.g JOIN cu{levels} c ON c.r = d.r, u{levels}
"""


ORACLES["op13_merkle"] = _manifest()
