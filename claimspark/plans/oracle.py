"""The registered queries in plain SQL, for a cross-check by another engine.

Shared parts are named common table expressions; a statement lists only those it needs.
"""

from __future__ import annotations

import re

from ..functions import html, text
from ..operators import classify, polarity, prompts, publish, summarize, themes, truth
from ..schemas import (
    CATEGORIES,
    CLAIM_STATUSES,
    CLASSIFICATION_FAILED,
    CONFIDENCES,
    FIELDS_DEFAULTED,
    SENTIMENTS,
    STORE_STATUSES,
    SUMMARY_FAILED,
)
from .queries import FUZZY_THRESHOLD, PATTERNS, RUN_TS, TOPICS

WS = text.WHITESPACE
WORD = r"[\p{L}\p{N}]+"


def q(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(WS + '+')}, ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def not_blank(c: str) -> str:
    return f"coalesce({strip(c)} <> '', false)"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {q(WORD)})"


def norm(c: str) -> str:
    return f"array_to_string({words(c)}, ' ')"


def cleaned(c: str) -> str:
    t = collapse(f"coalesce({c}, '')")
    return (
        f"CASE WHEN length({t}) < 100 THEN '' "
        f"WHEN length({t}) > 5000 THEN substring({t}, 1, 5000) || '...' ELSE {t} END"
    )


def titled(c: str) -> str:
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = f"regexp_extract_all({c}, {q(f'[{cased}]+|[^{cased}]+')})"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || lower(r[2:])), '')"


def url_title(c: str) -> str:
    last = f"split({c}, '/')[-1]"
    host = f"split(split({c}, '//')[2], '/')[1]"
    named = titled(f"replace(replace({last}, '-', ' '), '_', ' ')")
    by_host = titled(f"replace({host}, 'www.', '')")
    return (
        f"CASE WHEN {last} <> '' AND NOT contains({last}, '.') THEN {named} "
        f"WHEN {host} IS NOT NULL THEN {by_host} ELSE 'Untitled' END"
    )


def entities(c: str) -> str:
    for name, char in html.ENTITIES:
        c = f"replace({c}, {q(name)}, {q(char)})"
    return c


def plain(c: str) -> str:
    return collapse(entities(f"regexp_replace({c}, {q(html.TAG)}, ' ', 'g')"))


def sentences(c: str) -> str:
    return f"list_transform(string_split_regex({c}, '[.!?]+'), lambda s: {strip('s')})"


def claim_list(c: str, most: int | None) -> str:
    long = f"list_filter({sentences(c)}, lambda s: length(s) > 20)"
    cut = f"[1:{most}]" if most else ""
    return f"(CASE WHEN len({long}) = 0 THEN [{c}] ELSE {long} END){cut}"


def unnested(table: str, keys: str, items: str, item: str) -> str:
    """``keys, pos, item``, one row per list element, ``pos`` from 0."""
    return (
        f"SELECT {keys}, pos - 1 AS pos, _l[pos] AS {item} FROM "
        f"(SELECT {keys}, _l, unnest(range(1, len(_l) + 1)) AS pos "
        f"FROM (SELECT {keys}, {items} AS _l FROM {table}))"
    )


def choice(values, index: str) -> str:
    return f"{texts(values)}[CAST({index} AS BIGINT) % {len(values)} + 1]"


CATEGORY_ORDER = "list_position(" + texts(CATEGORIES) + ", category)"


def vote(facts: str, myths: str, unsure: str) -> str:
    return (
        f"CASE WHEN {facts} > {myths} AND {facts} > {unsure} THEN 'Fact' "
        f"WHEN {myths} > {facts} AND {myths} > {unsure} THEN 'Myth' ELSE 'Unsure' END"
    )


def results_cte(claims: str) -> str:
    """One result row per claim of the given claim table."""
    return f"""
        SELECT c.article_id, c.pos, c.claim,
          CASE WHEN r.norm IS NULL THEN 'Unsure'
               WHEN lower(coalesce(textual_rating, '')) IN ('true', 'fact') THEN 'Fact'
               ELSE 'Myth' END AS status,
          CASE WHEN r.norm IS NULL THEN 'No fact-check found'
               ELSE coalesce(textual_rating, 'Unknown') END AS rating,
          CASE WHEN r.norm IS NULL THEN 'None' ELSE coalesce(publisher, 'Unknown') END AS publisher,
          coalesce(publisher_site, '') AS publisher_site,
          coalesce(review_url, '') AS review_url,
          coalesce(review_date, '') AS review_date,
          CASE WHEN r.norm IS NULL THEN 'low' ELSE 'high' END AS confidence
        FROM {claims} c LEFT JOIN review_index r ON r.norm = {norm('c.claim')}"""


def votes_cte(results: str) -> str:
    counts = [f"count(*) FILTER (status = {q(s)})" for s in CLAIM_STATUSES]
    named = ", ".join(f"{c} AS {s.lower()}_count" for c, s in zip(counts, CLAIM_STATUSES))
    return (
        f"SELECT article_id, count(*) AS claim_count, {named}, {vote(*counts)} AS overall_status "
        f"FROM {results} GROUP BY article_id"
    )


def category_cte(table: str, column: str) -> str:
    rows = ", ".join(
        f"({q(c)}, {q(t)}, {w})" for c, terms in classify.LEXICON.items() for t, w in terms.items()
    )
    return f"""
        SELECT d.article_id, coalesce(b.category, 'Other') AS classification
        FROM {table} d LEFT JOIN (
          SELECT article_id, category,
            row_number() OVER (PARTITION BY article_id ORDER BY score DESC, {CATEGORY_ORDER}) AS rn
          FROM (SELECT article_id, category, round(sum(weight), 6) AS score
                FROM (SELECT article_id, unnest({words(column)}) AS term FROM {table})
                JOIN (VALUES {rows}) lex(category, term, weight) USING (term)
                GROUP BY ALL)) b
        ON b.article_id = d.article_id AND b.rn = 1"""


def sentiment_sql(table: str, column: str) -> str:
    plus = texts([t for t, s in classify.POLARITY.items() if s > 0])
    minus = texts([t for t, s in classify.POLARITY.items() if s < 0])

    def count(terms: str) -> str:
        return f"len(list_filter({words(column)}, lambda t: list_contains({terms}, t)))"

    return f"""
        SELECT article_id, positive, negative,
          CASE WHEN positive = 0 AND negative = 0 THEN 'neutral'
               WHEN positive >= 2 * negative THEN 'positive'
               WHEN negative >= 2 * positive THEN 'negative' ELSE 'mixed' END AS sentiment
        FROM (SELECT article_id, {count(plus)} AS positive, {count(minus)} AS negative FROM {table})"""


def polarity_sql(final: str) -> str:
    """``l``: learned words; ``v``: all words with the sign of their place; ``g``: weights of learned words and seeds."""
    seeds = ", ".join(f"({q(t)}, {s})" for t, s in polarity.SEEDS.items())
    k, own = polarity.SMOOTHING, polarity.SEED_WEIGHT
    return f"""
        WITH seeds(token, side) AS (VALUES {seeds}),
        s AS (SELECT article_id, pos, {words('sentence')} AS w FROM ({unnested('articles', 'article_id', sentences('text'), 'sentence')})),
        i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM s),
        v AS (SELECT article_id, pos, w[i] AS token,
              CASE WHEN list_has_any(w[greatest(i - {polarity.SCOPE}, 1):i - 1], {texts(polarity.NEGATIONS)}) THEN -1 ELSE 1 END AS sign FROM i),
        f AS (SELECT article_id, pos, max(CASE WHEN sign * side = 1 THEN 1 ELSE 0 END) AS p, max(CASE WHEN sign * side = -1 THEN 1 ELSE 0 END) AS n
              FROM v JOIN seeds USING (token) GROUP BY ALL),
        a AS (SELECT sum(p) AS ps, sum(n) AS ns FROM f),
        c AS (SELECT token, CAST(sum(CASE WHEN sign > 0 THEN p ELSE n END) AS BIGINT) AS positive,
              CAST(sum(CASE WHEN sign > 0 THEN n ELSE p END) AS BIGINT) AS negative
              FROM (SELECT DISTINCT article_id, pos, token, sign FROM v) JOIN f USING (article_id, pos)
              WHERE token NOT IN (SELECT token FROM seeds) AND NOT list_contains({texts(polarity.NEGATIONS)}, token) GROUP BY token),
        r AS (SELECT token, positive, negative, round(log2((positive + {k}) * (ns + 1) / ((negative + {k}) * (ps + 1))), 6) AS weight FROM c, a),
        l AS (SELECT * FROM r WHERE positive + negative >= {polarity.MIN_COUNT} AND abs(weight) >= {polarity.MIN_WEIGHT}),
        g AS (SELECT token, weight FROM l UNION ALL SELECT token, side * {own}::DOUBLE FROM seeds)
        {final}"""


LEARNED_SENTIMENT = f"""
    , h AS (SELECT article_id, CAST(sum(CASE WHEN sign * weight > 0 THEN CAST(round(abs(weight) * 1000000) AS BIGINT) ELSE 0 END) AS DOUBLE) / 1000000 AS positive,
            CAST(sum(CASE WHEN sign * weight < 0 THEN CAST(round(abs(weight) * 1000000) AS BIGINT) ELSE 0 END) AS DOUBLE) / 1000000 AS negative FROM v JOIN g USING (token) GROUP BY article_id),
    o AS (SELECT d.article_id, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative FROM articles d LEFT JOIN h USING (article_id))
    SELECT *, CASE WHEN positive = 0 AND negative = 0 THEN 'neutral' WHEN positive >= negative * {polarity.RATIO} THEN 'positive'
      WHEN negative >= positive * {polarity.RATIO} THEN 'negative' ELSE 'mixed' END AS sentiment FROM o"""


def themes_sql(table: str, column: str) -> str:
    return f"""
        WITH t AS (SELECT article_id, unnest({words(column)}) AS token FROM {table}),
        c AS (SELECT article_id, token, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT token, count(*) AS df FROM c GROUP BY token),
        s AS (SELECT article_id, token,
                round(tf * (ln(((SELECT count(*) FROM {table}) + 1) / (df + 1)) + 1), 6) AS score
              FROM c JOIN d USING (token)),
        r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, token) AS rn FROM s)
        SELECT article_id, string_agg(token, ' | ' ORDER BY rn) AS key_themes
        FROM r WHERE rn <= 5 GROUP BY article_id"""


def phrases_sql(table: str, column: str) -> str:
    def h(x: str) -> str:
        return f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END"

    cells = " + ".join(h(x) for x in ("n12", "n1 - n12", "n2 - n12", "n - n1 - n2 + n12", "n"))
    sides = " - ".join(h(x) for x in ("n1", "n - n1", "n2", "n - n2"))
    return f"""
        WITH w AS (SELECT article_id, {words(column)} AS w FROM {table}),
        p AS (SELECT article_id, w[k] AS a, w[k + 1] AS b FROM (SELECT article_id, w, unnest(range(1, len(w))) AS k FROM w)),
        c AS (SELECT article_id, a, b, count(*) AS tf FROM p GROUP BY ALL),
        both_in AS (SELECT a, b, CAST(sum(tf) AS DOUBLE) AS n12 FROM c GROUP BY a, b),
        t AS (SELECT a, b, n12, sum(n12) OVER (PARTITION BY a) AS n1, sum(n12) OVER (PARTITION BY b) AS n2, sum(n12) OVER () AS n FROM both_in),
        r AS (SELECT a, b, round(2 * ({cells} - {sides}), 4) AS ratio FROM t WHERE n12 >= {themes.MIN_COUNT} AND n12 * n > n1 * n2),
        s AS (SELECT article_id, a || ' ' || b AS phrase, round(tf * ratio, 3) AS score FROM c JOIN r USING (a, b) WHERE ratio >= {themes.MIN_RATIO}),
        o AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, phrase) AS rn FROM s)
        SELECT article_id, string_agg(phrase, ' | ' ORDER BY rn) AS key_phrases FROM o WHERE rn <= 5 GROUP BY article_id"""


def formatted_sql() -> str:
    """The lines of the article of each page; its only heading is the first, and it has no lists."""
    ends = "</?(?:article|h1|p)\\b[^<>]*>"
    inside = "regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\\z)', 1)"
    blocks = f"(SELECT count(*) FROM (SELECT unnest(string_split_regex(regexp_replace(html, '(?s)<!--.*?-->|<style>.*?</style>|<script>.*?</script>', '', 'g'), {q('</?(?:html|head|title|body|nav|ul|li|div|article|h1|p|footer)')} || '[^<>]*>')) AS b) WHERE trim(regexp_replace(b, '<[^<>]*>', '', 'g')) <> '')"
    lines = f"list_filter(list_transform(string_split_regex(regexp_replace({inside}, '<br>', ' ', 'g'), {q(ends)}), lambda b: {plain('b')}), lambda b: b <> '')"
    return f"""
        WITH l AS (SELECT page_id AS article_id, url, {lines} AS l, {blocks} AS n_blocks FROM pages)
        SELECT article_id, url, CASE WHEN len(l) > 0 THEN '# ' || array_to_string(l, chr(10)) ELSE '' END AS text,
               CAST(n_blocks AS INTEGER) AS n_blocks, CAST(len(l) AS INTEGER) AS n_kept FROM l"""


def truth_sql(final: str) -> str:
    """Rounds of beliefs and weights, one after the other."""
    rating = "CASE WHEN fact THEN 'True' WHEN (article_id + pos) % 5 > 0 THEN 'False' END"
    flipped = "desk = 4 OR (desk = 3 AND (article_id + pos) % 3 = 0) OR (desk < 3 AND (article_id * 7 + pos * 3 + desk) % 11 = 0)"
    parts = [
        f"said AS (SELECT norm, publisher, {rating} AS rating FROM (SELECT *, 'Desk ' || desk AS publisher, ((article_id + pos) % 2 = 0) <> ({flipped}) AS fact "
        f"FROM (SELECT article_id, pos, {norm('claim')} AS norm, unnest(range(0, 5)) AS desk FROM claims) WHERE norm <> '' AND (article_id + desk) % 4 <> 0))",
        "taken AS (SELECT norm AS claim, publisher, avg(CASE WHEN lower(coalesce(rating, '')) IN ('true', 'fact') THEN 1 ELSE 0 END) AS stand, "
        "count(*) AS n FROM said GROUP BY ALL)",
        "w0 AS (SELECT DISTINCT publisher, CAST(1 AS DOUBLE) AS weight FROM taken)",
    ]
    s = truth.SMOOTHING
    for k in range(truth.ROUNDS + 1):
        parts.append(
            f"b{k} AS (SELECT claim, CASE WHEN sum(weight) > 0 THEN round(sum(weight * stand) / sum(weight), 9) ELSE 0.5 END AS belief, "
            f"CAST(sum(n) AS BIGINT) AS reviews FROM taken JOIN w{k} USING (publisher) GROUP BY claim)"
        )
        if k < truth.ROUNDS:
            parts.append(
                f"w{k + 1} AS (SELECT publisher, round(greatest(ln((g + {s}) / (1 - g + {s})), 0), 9) AS weight "
                f"FROM (SELECT publisher, avg(1 - abs(stand - belief)) AS g FROM taken JOIN b{k} USING (claim) GROUP BY publisher))"
            )
    return "WITH " + ", ".join(parts) + " " + final


def summary_sql(table: str, column: str) -> str:
    return f"""
        WITH s AS ({unnested(table, 'article_id', sentences(f'substring({column}, 1, 3000)'), 'sentence')}),
        t AS (SELECT article_id, pos, unnest({words('sentence')}) AS token FROM s),
        f AS (SELECT article_id, token, count(*) AS freq FROM t GROUP BY ALL),
        g AS (SELECT article_id, pos, round(avg(freq), 6) AS score
              FROM t JOIN f USING (article_id, token) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, pos) AS rn FROM g),
        p AS (SELECT article_id, string_agg(sentence, '. ' ORDER BY pos) || '.' AS summary
              FROM r JOIN s USING (article_id, pos) WHERE rn <= 3 GROUP BY article_id)
        SELECT d.article_id, p.summary FROM {table} d LEFT JOIN p USING (article_id)"""


def central_sql(table: str, column: str) -> str:
    """Ranks after as many rounds as the operator does."""
    d = summarize.DAMPING
    return f"""
        WITH RECURSIVE s AS ({unnested(table, 'article_id', sentences(f'substring({column}, 1, 3000)'), 'sentence')}),
        t AS (SELECT DISTINCT article_id, pos, unnest({words('sentence')}) AS token FROM s),
        z AS (SELECT article_id, pos, count(*) AS size, count(*) OVER (PARTITION BY article_id) AS n FROM t GROUP BY article_id, pos),
        c AS (SELECT x.article_id, x.pos AS a, y.pos AS b, count(*) AS shared
              FROM t x JOIN t y ON x.article_id = y.article_id AND x.token = y.token GROUP BY ALL),
        w AS (SELECT c.article_id, a, b, shared / sqrt(x.size * y.size) AS w FROM c
              JOIN z x ON x.article_id = c.article_id AND x.pos = a JOIN z y ON y.article_id = c.article_id AND y.pos = b),
        e AS (SELECT article_id, a, b, w / sum(w) OVER (PARTITION BY article_id, a) AS step FROM w),
        r AS (SELECT 0 AS round, article_id, pos, 1.0::DOUBLE / n AS score, n FROM z
              UNION ALL
              SELECT r.round + 1, e.article_id, e.b, (1 - {d}::DOUBLE) / any_value(r.n) + {d}::DOUBLE * sum(r.score * e.step), any_value(r.n)
              FROM r JOIN e ON e.article_id = r.article_id AND e.a = r.pos WHERE r.round < {summarize.CENTRAL_ROUNDS}
              GROUP BY r.round, e.article_id, e.b),
        o AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(score, 6) DESC, pos) AS rn
              FROM r WHERE round = {summarize.CENTRAL_ROUNDS}),
        p AS (SELECT article_id, string_agg(sentence, '. ' ORDER BY pos) || '.' AS summary
              FROM o JOIN s USING (article_id, pos) WHERE rn <= 3 GROUP BY article_id)
        SELECT d.article_id, p.summary FROM {table} d LEFT JOIN p USING (article_id)"""


def confidence_sql(reviewed: str, total: str) -> str:
    return (
        f"CASE WHEN {reviewed} = 0 THEN 'low' WHEN {reviewed} * 2 >= {total} THEN 'high' "
        "ELSE 'medium' END"
    )


NOTES = (
    "claim_count || ' claims: ' || fact_count || ' confirmed, ' || myth_count || ' refuted, ' "
    "|| unsure_count || ' without review'"
)
CREDIBILITY = (
    "CASE WHEN claim_count = 0 THEN 0.5 "
    "ELSE round((fact_count + unsure_count * 0.5) / claim_count, 3) END"
)


def filled(template: str, **values: str) -> str:
    """The template as a concatenation of literals and expressions."""
    parts = re.split(r"\{(\w+)\}", template.replace("{{", "\x01").replace("}}", "\x02"))
    out = []
    for i, part in enumerate(parts):
        if i % 2:
            out.append(f"({values[part]})")
        elif part:
            out.append(q(part.replace("\x01", "{").replace("\x02", "}")))
    return " || ".join(out)


def responses_sql() -> str:
    """The model answers, shape by shape."""
    escaped = "text"
    for char, escape in [("\\", "\\\\"), ('"', '\\"')]:
        escaped = f"replace({escaped}, {q(char)}, {q(escape)})"
    for code, escape in [(10, "\\n"), (13, "\\r"), (9, "\\t")]:
        escaped = f"replace({escaped}, chr({code}), {q(escape)})"
    label = f"CASE WHEN doc_id % 17 = 0 THEN 'Sports' ELSE {choice(CATEGORIES, 'doc_id')} END"
    head = (
        f"""'{{"classification": "' || ({label}) || '", "confidence": "' || """
        f"""{choice(CONFIDENCES, 'doc_id // 2')} || '", "key_themes": ["' || lang || '", "' || source """
        f"""|| '"], "analysis_notes": "' || {escaped} || '"'"""
    )
    mood = f"""', "sentiment": "' || {choice(SENTIMENTS, 'doc_id // 3')} || '"'"""
    tail = """', "credibility_score": 0.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '}'"""
    return f"""
        SELECT article_id, CASE kind
          WHEN 0 THEN h || m || t
          WHEN 1 THEN '```json' || chr(10) || h || m || t || chr(10) || '```'
          WHEN 2 THEN 'Here: ```' || chr(10) || h || m || t || chr(10) || '``` done'
          WHEN 3 THEN '```json' || chr(10) || h || m || t
          WHEN 4 THEN 'Sure: ' || h || m || t || ' Anything else?'
          WHEN 5 THEN h || t
          WHEN 6 THEN h || ', "sentiment": null' || t
          WHEN 7 THEN '[' || article_id || ']'
          WHEN 8 THEN '```json' || chr(10) || h || m || t || ' trailing' || chr(10) || '```'
          WHEN 9 THEN replace(h || m || t, '"', '''')
          WHEN 10 THEN ' ' || chr(10) || ' '
          ELSE ' No answer for ' || source || ' ' END AS response
        FROM (SELECT doc_id AS article_id, doc_id % 12 AS kind, source,
                {head} AS h, {mood} AS m, {tail} AS t FROM documents)"""


def extract_sql() -> str:
    """Fence rules, then braces, then the stripped text."""

    def fenced(opening: str) -> str:
        start = f"instr(response, '{opening}')"
        rest = f"substring(response, {start} + {len(opening)})"
        return (
            f"CASE WHEN {start} > 0 AND instr({rest}, '```') > 0 "
            f"THEN {strip(f'substring({rest}, 1, instr({rest}, {q('```')}) - 1)')} END"
        )

    first, last = "instr(response, '{')", "(length(response) - instr(reverse(response), '}') + 1)"
    braces = (
        f"CASE WHEN {first} > 0 AND instr(reverse(response), '}}') > 0 AND {last} > {first} "
        f"THEN substring(response, {first}, {last} - {first} + 1) END"
    )
    return (
        f"SELECT article_id, coalesce({fenced('```json')}, {fenced('```')}, {braces}, "
        f"{strip('response')}) AS json_text FROM responses"
    )


def parsed_sql() -> str:
    defaults = {
        "classification": ("'Other'", "'Other'"),
        "confidence": ("'medium'", "'low'"),
        "key_themes": ("''", "''"),
        "analysis_notes": (q(FIELDS_DEFAULTED), q(CLASSIFICATION_FAILED)),
        "sentiment": ("'neutral'", "'neutral'"),
        "credibility_score": ("0.5", "0.3"),
    }
    reads = {f: f"j->>'$.{f}'" for f in defaults}
    reads["key_themes"] = "array_to_string(CAST(j->'$.key_themes' AS VARCHAR[]), ' | ')"
    reads["credibility_score"] = "CAST(j->>'$.credibility_score' AS DOUBLE)"
    complete = f"len(list_intersect(json_keys(j), {texts(defaults)})) = {len(defaults)}"
    columns = ", ".join(
        f"CASE WHEN j IS NULL THEN {failed} WHEN {complete} THEN {reads[f]} "
        f"ELSE coalesce({reads[f]}, {missing}) END AS {f}"
        for f, (missing, failed) in defaults.items()
    )
    return f"""
        SELECT article_id, j IS NOT NULL AS parsed_ok, {columns}
        FROM (SELECT article_id, CASE WHEN json_type(v) = 'OBJECT' THEN v END AS j
              FROM (SELECT article_id,
                      CASE WHEN json_valid(json_text) THEN CAST(json_text AS JSON) END AS v
                    FROM json_texts))"""


REVIEWED = "fact_count + myth_count"
ARTICLE_URL = "'https://' || source || '.example.org/' || lang || '/' || doc_id"

_CTES: dict[str, tuple[list[str], str]] = {
    "articles": (
        [],
        f"SELECT doc_id AS article_id, {ARTICLE_URL} AS url, {url_title(f'({ARTICLE_URL})')} AS title, "
        "text AS content, text AS summary, text FROM documents",
    ),
    "extracted": (
        [],
        f"""
        SELECT page_id AS article_id, url, html,
          {plain(f'''coalesce(nullif(regexp_extract(v, {q(html.ARTICLE)}, 1), ''),
            regexp_replace(coalesce(nullif(regexp_extract(v, {q(html.BODY)}, 1), ''), v),
                           {q(html.CHROME)}, ' ', 'g'))''')} AS text,
          coalesce({plain(f"regexp_extract(html, {q(html.TITLE)}, 1)")}, '') AS title
        FROM (SELECT *, regexp_replace(html, {q(html.INVISIBLE)}, ' ', 'g') AS v FROM pages)""",
    ),
    "scrapes": (
        ["extracted"],
        f"""
        SELECT article_id, url, content,
          coalesce(nullif(title, ''), {url_title('url')}) AS title,
          CASE WHEN coalesce(length(html), 0) = 0 THEN 'download' WHEN coalesce(text, '') = '' THEN 'extract'
               WHEN content = '' THEN 'content' END AS reject
        FROM (SELECT *, {cleaned('text')} AS content FROM extracted)""",
    ),
    "scraped": (["scrapes"], "SELECT article_id, url, content, title FROM scrapes WHERE reject IS NULL"),
    "reviews": (
        [],
        f"""
        SELECT item_id * 100000 + pos AS review_id, claim_text,
          CASE item_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'FACT' WHEN 2 THEN 'False'
               WHEN 3 THEN 'Mostly True' END AS textual_rating,
          CASE WHEN item_id % 7 <> 0 THEN 'Desk ' || item_id % 7 END AS publisher,
          CASE WHEN item_id % 7 <> 0 THEN 'desk' || item_id % 7 || '.example.org' END AS publisher_site,
          'https://reviews.example.org/' || (item_id * 100000 + pos) AS review_url,
          CASE WHEN item_id % 6 <> 0
               THEN '2024-01-' || lpad(CAST(item_id % 28 + 1 AS VARCHAR), 2, '0') END AS review_date
        FROM ({unnested('benchmark', 'item_id', sentences('text'), 'claim_text')})
        WHERE length(claim_text) > 20""",
    ),
    "review_index": (
        ["reviews"],
        f"SELECT * FROM (SELECT *, {norm('claim_text')} AS norm FROM reviews) WHERE norm <> '' "
        "QUALIFY row_number() OVER (PARTITION BY norm ORDER BY review_id) = 1",
    ),
    "claims": (["articles"], unnested("articles", "article_id", claim_list("text", 5), "claim")),
    "all_claims": (["articles"], unnested("articles", "article_id", claim_list("text", None), "claim")),
    "results": (["claims", "review_index"], results_cte("claims")),
    "all_results": (["all_claims", "review_index"], results_cte("all_claims")),
    "votes": (["results"], votes_cte("results")),
    "all_votes": (["all_results"], votes_cte("all_results")),
    "responses": ([], responses_sql()),
    "json_texts": (["responses"], extract_sql()),
    "parsed": (["json_texts"], parsed_sql()),
    "analysed": (
        ["articles", "votes", "parsed", "claims"],
        """
        SELECT a.article_id, url, title, content, summary, overall_status AS overall_fact_status,
          CASE overall_status WHEN 'Unsure' THEN 'Unclear' ELSE overall_status END AS fact_myth_status,
          k.key_claims, parsed.* EXCLUDE (article_id)
        FROM articles a JOIN votes USING (article_id) JOIN parsed USING (article_id)
        JOIN (SELECT article_id, list(claim ORDER BY pos) AS key_claims FROM claims GROUP BY ALL) k
          USING (article_id)""",
    ),
    "sessions": (
        ["analysed"],
        """
        SELECT regexp_extract(url, '//(.*)/[^/]*$', 1) AS topic, count(*) AS articles_found,
          count(*) FILTER (fact_myth_status = 'Fact') AS facts_count,
          count(*) FILTER (fact_myth_status = 'Myth') AS myths_count,
          count(*) FILTER (fact_myth_status = 'Unclear') AS unclear_count,
          TIMESTAMP '2024-01-01' + to_minutes(max(article_id)) AS saved_at
        FROM analysed GROUP BY 1""",
    ),
    "first_run": (
        ["articles"],
        f"""
        SELECT article_id, CASE WHEN article_id % 50 = 7 THEN NULL
            WHEN article_id % 3 = 1 THEN 'https://hot.example.org/news' ELSE url END AS url,
          title, summary, {choice(CATEGORIES, 'article_id')} AS classification,
          CASE article_id % 4 WHEN 0 THEN 'Fact' WHEN 1 THEN 'Myth' WHEN 2 THEN 'Unclear' END
            AS fact_myth_status,
          TIMESTAMP '2024-01-01' + to_seconds(article_id) AS saved_at
        FROM articles""",
    ),
    "submitted": (
        ["first_run"],
        """
        SELECT * FROM first_run UNION ALL
        SELECT article_id, url, 'Update ' || title, summary, 'Health', 'Fact',
          TIMESTAMP '2024-06-01' + to_seconds(article_id % 1000)
        FROM first_run WHERE article_id % 3 = 0""",
    ),
    "current_rows": (
        ["submitted"],
        """
        SELECT url, coalesce(title, '') AS title, coalesce(summary, '') AS summary,
          coalesce(classification, '') AS classification,
          coalesce(fact_myth_status, '') AS fact_myth_status,
          strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS created_at, article_id AS seq
        FROM submitted WHERE url IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY saved_at DESC, article_id DESC) = 1""",
    ),
    "published": (
        ["analysed"],
        f"""
        SELECT article_id,
          substring(coalesce(CASE WHEN article_id % 8 <> 0 THEN title END, 'Untitled'), 1, 2000) AS "Title",
          coalesce(url, '') AS "URL",
          CASE WHEN {not_blank('substring(content, 1, 2000)')} THEN substring(content, 1, 2000) END AS "Content",
          CASE WHEN article_id % 6 > 1 AND {not_blank('substring(summary, 1, 2000)')}
               THEN substring(summary, 1, 2000) END AS "Summary",
          nullif(substring(array_to_string(list_filter(key_claims, lambda c: c <> ''), ', '), 1, 2000), '')
            AS "Claims",
          coalesce(list_filter({texts(STORE_STATUSES)}, lambda o: lower(o) = lower({strip('fact_myth_status')}))[1],
                   'Unclear') AS "Fact Status",
          coalesce(list_filter({texts(CATEGORIES)}, lambda o: lower(o) = lower({strip('classification')}))[1],
                   'Other') AS "Classification",
          CASE WHEN article_id % 5 = 1 THEN 'Medium' ELSE
            coalesce(list_filter({texts(publish.OPTIONS['Confidence'])},
                                 lambda o: lower(o) = lower({strip('confidence')}))[1], 'Medium')
          END AS "Confidence",
          CASE WHEN article_id % 2 = 0 THEN '2024-02-29' ELSE '{RUN_TS:%Y-%m-%d}' END AS "Analysis Date"
        FROM analysed""",
    ),
    "sum_pages": (["scraped"], summary_sql("scraped", "content")),
    "page_summaries": (
        ["scraped", "sum_pages"],
        f"SELECT s.article_id, url, title, content, coalesce({strip('p.summary')}, {q(SUMMARY_FAILED)}) AS summary "
        f"FROM (SELECT * FROM scraped WHERE starts_with(url, 'http://') OR starts_with(url, 'https://')) s "
        "JOIN sum_pages p USING (article_id)",
    ),
    "page_claims": (["page_summaries"], unnested("page_summaries", "article_id", claim_list("summary", 5), "claim")),
    "page_results": (["page_claims", "review_index"], results_cte("page_claims")),
    "page_votes": (["page_results"], votes_cte("page_results")),
    "page_category": (["page_summaries"], category_cte("page_summaries", "summary")),
    "page_sentiment": (["page_summaries"], sentiment_sql("page_summaries", "summary")),
    "page_themes": (["page_summaries"], themes_sql("page_summaries", "summary")),
}


def statement(final: str, *needs: str) -> str:
    """``final`` behind the common table expressions it needs, directly or not."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for need in _CTES[name][0]:
                add(need)
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return final
    parts = ",\n".join(f"{name} AS ({_CTES[name][1]})" for name in ordered)
    body = f"SELECT * FROM ({final})" if final.lstrip().startswith("WITH") else final
    return f"WITH {parts}\n{body}"


def counts(column: str, vocabulary: list[str], table: str, *needs: str) -> str:
    values = ", ".join(f"({i}, {q(v)})" for i, v in enumerate(vocabulary, 1))
    return statement(
        f"SELECT position, value, count(t.{column}) AS n FROM (VALUES {values}) v(position, value) "
        f"LEFT JOIN {table} t ON t.{column} = value GROUP BY ALL",
        *needs,
    )


def map_text(column: str, vocabulary: list[str], alias: str) -> str:
    parts = [f"{q(v + '=')} || count(*) FILTER ({column} = {q(v)})" for v in vocabulary]
    return f"concat_ws(';', {', '.join(parts)}) AS {alias}"


COUNT_MAPS = ", ".join(
    [
        map_text("classification", CATEGORIES, "classification_counts"),
        map_text("overall_fact_status", CLAIM_STATUSES, "fact_status_counts"),
        map_text("confidence", CONFIDENCES, "confidence_counts"),
        map_text("sentiment", SENTIMENTS, "sentiment_counts"),
    ]
)
SUCCEEDED = (
    f"count(*) FILTER (NOT (classification IS NOT DISTINCT FROM 'Other' "
    f"AND analysis_notes IS NOT DISTINCT FROM {q(CLASSIFICATION_FAILED)}))"
)
MEAN_CREDIBILITY = "round(avg(coalesce(credibility_score, 0.5)), 3) AS average_credibility_score"
CURRENT_COLUMNS = "url, title, summary, classification, fact_myth_status, created_at"
SHOWN_AT = "strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS created_at"


def search_sql() -> str:
    topics = ", ".join(f"({q(t)})" for t in TOPICS)
    return statement(
        f"""
        WITH t AS (SELECT article_id, {words('text')} AS tokens FROM articles),
        s AS (SELECT count(*) AS n, avg(len(tokens)) AS mean_len FROM t),
        terms AS (SELECT DISTINCT topic, unnest({words('topic')}) AS token FROM (VALUES {topics}) v(topic)),
        c AS (SELECT article_id, len, token, count(*) AS tf
              FROM (SELECT article_id, len(tokens) AS len, unnest(tokens) AS token FROM t)
              WHERE token IN (SELECT token FROM terms) GROUP BY ALL),
        w AS (SELECT token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf
              FROM (SELECT token, count(*) AS df FROM c GROUP BY token), s),
        r AS (SELECT topic, article_id, round(sum(
                idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 6) AS score
              FROM c JOIN w USING (token) JOIN terms USING (token), s GROUP BY ALL)
        SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY score DESC, article_id) AS rank,
          article_id, score
        FROM r QUALIFY rank <= 10""",
        "articles",
    )


def fuzzy_sql() -> str:
    """Every claim against every review that shares a token with it."""
    t = FUZZY_THRESHOLD
    return statement(
        f"""
        WITH c AS (SELECT article_id, pos, list_distinct({words('claim')}) AS ws FROM claims),
        r AS (SELECT review_id, list_distinct(string_split(norm, ' ')) AS ws FROM review_index),
        k AS (SELECT article_id, pos, len(ws) AS n, unnest(ws) AS token FROM c),
        l AS (SELECT review_id, len(ws) AS m, unnest(ws) AS token FROM r),
        p AS (SELECT article_id, pos, review_id, n, m, count(*) AS shared
              FROM k JOIN l USING (token) GROUP BY ALL)
        SELECT article_id, pos, review_id, round(shared / (n + m - shared), 6) AS score
        FROM p WHERE shared >= {t} * (n + m - shared)
        QUALIFY row_number() OVER (PARTITION BY article_id, pos ORDER BY score DESC, review_id) = 1""",
        "claims",
        "review_index",
    )


def payload_sql() -> str:
    kept = ", ".join(f'CASE WHEN "{p}" IS NOT NULL THEN {q(p)} END' for p in publish.PROPERTIES)
    return statement(f"""SELECT article_id, concat_ws(',', {kept}) AS kept, "Title" AS title FROM published""", "published")


def all_sql() -> dict[str, str]:
    listing = "concat_ws('/', status, rating, publisher)"
    prompt_results = filled(
        prompts.RESULT_LINES.replace("\n", "\x03"),
        i="pos + 1",
        claim="substring(claim, 1, 100)",
        status="status",
        rating="rating",
        publisher="publisher",
    ).replace("\x03", "\n")
    return {
        "search_topk": search_sql(),
        "search_postings": search_sql(),
        "valid_urls": """
            SELECT page_id, url FROM (SELECT page_id, CASE page_id % 6 WHEN 1 THEN upper(url)
              WHEN 2 THEN ' ' || url WHEN 3 THEN 'ftp' || substring(url, 5) WHEN 4 THEN NULL
              ELSE url END AS url FROM pages)
            WHERE starts_with(url, 'http://') OR starts_with(url, 'https://')""",
        "page_formatted": formatted_sql(),
        "page_text": statement("SELECT article_id, url, text FROM extracted", "extracted"),
        "page_metadata": statement(
            "SELECT article_id, url, title, "
            + ", ".join(
                collapse(entities(
                    f"regexp_extract(regexp_extract(html, {q(tag)}, 0), {q(html.CONTENT_ATTRIBUTE)}, 1) || "
                    f"regexp_extract(regexp_extract(html, {q(tag)}, 0), {q(html.CONTENT_ATTRIBUTE)}, 2)"
                )) + f" AS {field}"
                for field, tag in html.META.items()
            )
            + " FROM extracted",
            "extracted",
        ),
        "clean_content": f"SELECT doc_id AS article_id, {cleaned('text')} AS content FROM documents",
        "url_title": f"SELECT page_id AS article_id, url, {url_title('url')} AS title FROM pages",
        "scraped_articles": statement("SELECT * FROM scraped", "scraped"),
        "scrape_rejects": statement(
            "SELECT article_id, url, reject FROM scrapes WHERE reject IS NOT NULL", "scrapes"
        ),
        "scrape_counts": statement(
            "SELECT count(*) AS total_urls, count(*) FILTER (reject IS NULL) AS scraped, "
            + ", ".join(f"count(*) FILTER (reject = '{s}') AS rejected_{s}" for s in ("download", "extract", "content"))
            + " FROM scrapes",
            "scrapes",
        ),
        "search_json": """
            SELECT page_id AS article_id, 1 AS rank, url FROM pages
            UNION ALL SELECT page_id, 3, url || '?second' FROM pages""",
        "review_json": statement(
            """
            SELECT review_id, claim_text AS claim,
              CASE WHEN review_id % 9 >= 7 THEN 'Unsure'
                   WHEN lower(coalesce(textual_rating, '')) IN ('true', 'fact') THEN 'Fact' ELSE 'Myth' END AS status,
              CASE WHEN review_id % 9 >= 7 THEN 'No fact-check found' ELSE coalesce(textual_rating, 'Unknown') END AS rating,
              CASE WHEN review_id % 9 >= 7 THEN 'None' ELSE coalesce(publisher, 'Unknown') END AS publisher,
              CASE WHEN review_id % 9 >= 7 THEN '' ELSE coalesce(publisher_site, '') END AS publisher_site,
              CASE WHEN review_id % 9 >= 7 THEN '' ELSE review_url END AS review_url,
              CASE WHEN review_id % 9 >= 7 THEN '' ELSE coalesce(review_date, '') END AS review_date,
              CASE WHEN review_id % 9 >= 7 THEN 'low' ELSE 'high' END AS confidence
            FROM reviews""",
            "reviews",
        ),
        "central_summary": statement(central_sql("articles", "content"), "articles"),
        "extractive_summary": statement(summary_sql("articles", "content"), "articles"),
        "summary_fallback": statement(
            f"SELECT article_id, url, CASE WHEN article_id % 3 <> 0 THEN {strip('title')} "
            f"ELSE {q(SUMMARY_FAILED)} END AS summary FROM articles",
            "articles",
        ),
        "summary_prompt": statement(
            "SELECT article_id, "
            + filled(
                prompts.SUMMARY_PROMPT,
                title="CASE WHEN article_id % 4 <> 0 THEN title ELSE 'Untitled' END",
                url="url",
                content="substring(content, 1, 3000)",
            )
            + " AS prompt FROM articles",
            "articles",
        ),
        "classification_prompt": statement(
            "SELECT a.article_id, "
            + filled(
                prompts.CLASSIFICATION_PROMPT,
                url="url",
                title="title",
                summary="summary",
                status="overall_status",
                results=f"CASE WHEN claim_count > 0 THEN {q(prompts.RESULTS_HEAD)} || l.lines ELSE '' END",
                categories=q(", ".join(CATEGORIES)),
            )
            + f""" AS prompt FROM articles a JOIN votes USING (article_id) JOIN (
              SELECT article_id, string_agg({prompt_results}, '' ORDER BY pos) AS lines
              FROM results WHERE pos < 3 GROUP BY article_id) l USING (article_id)""",
            "articles", "votes",
        ),
        "claims": statement("SELECT * FROM claims", "claims"),
        "claim_review_exact": statement(
            f"SELECT article_id, pos, review_id FROM claims JOIN review_index ON norm = {norm('claim')}",
            "claims", "review_index",
        ),
        "claim_review_fuzzy": fuzzy_sql(),
        "claim_status": statement("SELECT * FROM results", "results"),
        "claim_votes": statement("SELECT * FROM votes", "votes"),
        "claim_votes_all": statement("SELECT * FROM all_votes", "all_votes"),
        "fact_checked": (checked := statement(
            f"""
            SELECT article_id, url, title, r.claims, r.results, overall_status
            FROM articles JOIN votes USING (article_id) JOIN (
              SELECT article_id, string_agg(claim, ' | ' ORDER BY pos) AS claims,
                string_agg({listing}, ' | ' ORDER BY pos) AS results
              FROM results GROUP BY article_id) r USING (article_id)""",
            "articles", "votes",
        )),
        "stage_files": checked,
        "classify_lexicon": statement(category_cte("articles", "text"), "articles"),
        "classify_join": statement(category_cte("articles", "text"), "articles"),
        "claim_truth": statement(
            truth_sql(
                f"SELECT claim, round(belief, 6) AS belief, reviews, "
                f"CASE WHEN belief > 0.5 THEN 'Fact' WHEN belief < 0.5 THEN 'Myth' ELSE 'Unsure' END AS status FROM b{truth.ROUNDS}"
            ),
            "claims",
        ),
        "publisher_weights": statement(truth_sql(f"SELECT publisher, round(weight, 6) AS weight FROM w{truth.ROUNDS}"), "claims"),
        "key_phrases": statement(phrases_sql("articles", "text"), "articles"),
        "key_themes": statement(themes_sql("articles", "text"), "articles"),
        "sentiment": statement(sentiment_sql("articles", "text"), "articles"),
        "polarity_weights": statement(polarity_sql("SELECT * FROM l"), "articles"),
        "learned_sentiment": statement(polarity_sql(LEARNED_SENTIMENT), "articles"),
        "article_confidence": statement(
            f"SELECT article_id, {confidence_sql(f'({REVIEWED})', 'claim_count')} AS confidence FROM all_votes",
            "all_votes",
        ),
        "credibility": statement(
            f"SELECT article_id, {CREDIBILITY} AS credibility_score, {NOTES} AS analysis_notes FROM all_votes",
            "all_votes",
        ),
        "extract_json": statement("SELECT * FROM json_texts", "json_texts"),
        "parse_responses": statement("SELECT * FROM parsed", "parsed"),
        "enrich_local": f"""
            SELECT doc_id AS article_id,
              CASE WHEN doc_id % 7 = 3 THEN -1
                   ELSE len(list_filter(string_split_regex(text, {q(WS + '+')}), lambda w: w <> '')) END AS words,
              doc_id % 7 <> 3 AS ok,
              CASE WHEN doc_id % 7 = 3 THEN 'ValueError: refused' END AS error,
              CASE WHEN doc_id % 7 = 3 THEN 3 ELSE 1 END AS attempts
            FROM documents""",
        "enrich_answers": f"""
            WITH a AS (SELECT doc_id AS article_id, text, length(text) % 7 <> 3 AS fine FROM documents)
            SELECT article_id, coalesce(fine, false) AS ok,
              CASE WHEN fine THEN len(list_filter(string_split_regex(text, {q(WS + '+')}), lambda w: w <> '')) ELSE -1 END AS words,
              CASE WHEN text IS NULL THEN 'no prompt' WHEN NOT fine THEN 'ValueError: refused' END AS error,
              CASE WHEN text IS NULL THEN 0 WHEN fine THEN 1 ELSE 3 END AS attempts,
              CASE WHEN fine AND text IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL) THEN 'first'
                   WHEN text IS NOT NULL THEN 'second' END AS run
            FROM a""",
        "classification_counts": counts("classification", CATEGORIES, "parsed", "parsed"),
        "fact_status_counts": counts("overall_status", CLAIM_STATUSES, "all_votes", "all_votes"),
        "confidence_counts": counts("confidence", CONFIDENCES, "parsed", "parsed"),
        "sentiment_counts": counts("sentiment", SENTIMENTS, "parsed", "parsed"),
        "analysis_summary": statement(
            f"SELECT count(*) AS total_articles, {COUNT_MAPS}, {MEAN_CREDIBILITY}, "
            f"{SUCCEEDED} AS successful_analyses FROM analysed HAVING count(*) > 0",
            "analysed",
        ),
        "workflow_summary": statement(
            f"SELECT 'article_analysis' AS workflow_type, count(*) AS total_articles_processed, "
            f"{SUCCEEDED} AS successful_analyses, count(*) - {SUCCEEDED} AS failed_analyses, "
            f"{COUNT_MAPS}, {MEAN_CREDIBILITY} FROM analysed HAVING count(*) > 0",
            "analysed",
        ),
        "session_stats": statement(f"SELECT * EXCLUDE (saved_at), {SHOWN_AT} FROM sessions", "sessions"),
        "summary_metrics": statement(
            """
            SELECT *, round(facts * 100.0 / total, 1) AS facts_percent, round(myths * 100.0 / total, 1) AS myths_percent,
              round(unclear * 100.0 / total, 1) AS unclear_percent, round(successful * 100.0 / total, 1) AS success_percent
            FROM (SELECT count(*) AS total, count(*) FILTER (fact_myth_status = 'Fact') AS facts,
                    count(*) FILTER (fact_myth_status = 'Myth') AS myths,
                    count(*) FILTER (fact_myth_status = 'Unclear') AS unclear,
                    count(*) FILTER (article_id % 10 <> 3) AS successful FROM analysed)""",
            "analysed",
        ),
        "stage_counts": statement(
            f"SELECT count(*) AS articles, count(*) FILTER (article_id % 10 <> 3) AS summarised, "
            f"count(*) FILTER (len(key_claims) > 0) AS fact_checked, {SUCCEEDED} AS classified FROM analysed",
            "analysed",
        ),
        "status_distribution": statement(
            "SELECT fact_myth_status, count(*) AS n FROM analysed WHERE fact_myth_status IS NOT NULL GROUP BY 1",
            "analysed",
        ),
        "class_distribution": statement(
            "SELECT classification, count(*) AS n FROM parsed WHERE classification IS NOT NULL GROUP BY 1", "parsed"
        ),
        "article_upsert": statement("SELECT * FROM current_rows", "current_rows"),
        "stream_upsert": statement("SELECT * FROM current_rows", "current_rows"),
        "stream_claim_status": statement("SELECT * FROM results", "results"),
        "stream_sessions": """
            SELECT topic, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started,
              strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS ended, count(*) AS articles_found,
              count(*) FILTER (event_type = 'view') AS facts_count, count(*) FILTER (event_type = 'error') AS myths_count,
              count(*) FILTER (event_type = 'click') AS unclear_count
            FROM (SELECT *, sum(CASE WHEN ts - before <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY topic ORDER BY ts, event_id) AS session
              FROM (SELECT *, CAST(user_id AS VARCHAR) AS topic, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
            GROUP BY topic, session""",
        "upsert_counts": statement(
            "SELECT count(*) AS received, count(url) AS saved, count(*) - count(url) AS refused FROM submitted",
            "submitted",
        ),
        "recent_articles": statement(
            f"SELECT {CURRENT_COLUMNS} FROM current_rows ORDER BY created_at DESC, url LIMIT 50", "current_rows"
        ),
        "recent_sessions": statement(
            f"SELECT * EXCLUDE (saved_at), {SHOWN_AT} FROM sessions ORDER BY saved_at DESC, topic LIMIT 10", "sessions"
        ),
        "history_tail": statement(
            "SELECT topic, strftime(saved_at, '%Y-%m-%dT%H:%M:%S') AS timestamp, articles_found AS articles_count "
            "FROM sessions ORDER BY saved_at DESC, topic LIMIT 3",
            "sessions",
        ),
        "articles_by_topic": statement(
            f"SELECT {CURRENT_COLUMNS} FROM current_rows WHERE url ILIKE '%LICEN_E%' OR title ILIKE '%LICEN_E%' "
            "OR summary ILIKE '%LICEN_E%'",
            "current_rows",
        ),
        "pattern_index": statement(
            f"SELECT {CURRENT_COLUMNS}, pattern FROM current_rows, (SELECT unnest({texts(PATTERNS)}) AS pattern) "
            "WHERE " + " OR ".join(f"{c} ILIKE '%' || pattern || '%'" for c in ("url", "title", "summary")),
            "current_rows",
        ),
        "stats_by_classification": statement(
            "SELECT classification, count(*) AS n FROM current_rows GROUP BY 1", "current_rows"
        ),
        "stats_by_status": statement(
            "SELECT fact_myth_status, count(*) AS n FROM current_rows GROUP BY 1", "current_rows"
        ),
        "database_stats": statement(
            """
            SELECT 'total_articles' AS stat, NULL AS value, count(*) AS n FROM current_rows
            UNION ALL SELECT 'total_sessions', NULL, count(*) FROM sessions
            UNION ALL SELECT 'classification', classification, count(*) FROM current_rows GROUP BY 2
            UNION ALL SELECT 'fact_myth_status', fact_myth_status, count(*) FROM current_rows GROUP BY 2""",
            "current_rows", "sessions",
        ),
        "publish_rows": statement("SELECT * FROM published", "published"),
        "publish_counts": statement(
            "SELECT count(*) AS rows, count(*) FILTER (article_id % 9 <> 0 AND article_id % 11 <> 0) AS published FROM published", "published"
        ),
        "publish_payload": payload_sql(),
        "run_names": statement(
            f"SELECT topic, topic || '_{RUN_TS:%Y%m%d_%H%M%S}' AS run_name FROM sessions", "sessions"
        ),
        "article_listing": statement(
            """
            SELECT article_id, url, CASE WHEN article_id % 3 <> 0 THEN title ELSE 'Untitled Article' END AS title,
              CASE WHEN article_id % 5 <> 0 THEN fact_myth_status ELSE 'Unclear' END AS fact_myth_status,
              CASE WHEN article_id % 4 <> 0 THEN summary ELSE 'No summary available' END AS summary,
              coalesce(classification, 'Other') AS classification, coalesce(confidence, 'medium') AS confidence,
              array_to_string(key_claims, ' | ') AS key_claims
            FROM analysed""",
            "analysed",
        ),
        "csv_rows": statement(
            """
            SELECT article_id, url, title, CAST(to_json(k.claims) AS VARCHAR) AS claims, overall_status
            FROM articles JOIN votes USING (article_id) JOIN (
              SELECT article_id, list(claim ORDER BY pos) AS claims FROM claims GROUP BY ALL) k USING (article_id)""",
            "articles", "votes",
        ),
        "analysed_articles": (composed := statement(
            f"""
            SELECT s.article_id, url, title, content, summary, r.claims, r.fact_check_results,
              overall_status AS overall_fact_status, classification,
              {confidence_sql(f'({REVIEWED})', 'claim_count')} AS confidence,
              coalesce(key_themes, '') AS key_themes, {NOTES} AS analysis_notes, sentiment,
              {CREDIBILITY} AS credibility_score
            FROM page_summaries s JOIN page_votes USING (article_id) JOIN page_category USING (article_id)
            JOIN page_sentiment USING (article_id) LEFT JOIN page_themes USING (article_id) JOIN (
              SELECT article_id, string_agg(claim, ' | ' ORDER BY pos) AS claims,
                string_agg(status, ',' ORDER BY pos) AS fact_check_results
              FROM page_results GROUP BY article_id) r USING (article_id)""",
            "page_summaries", "page_votes", "page_category", "page_sentiment", "page_themes",
        )),
        "stream_analysed": composed,
        "stream_equals_batch": statement(
            f"""
            SELECT url, title, summary, classification,
              CASE overall_status WHEN 'Unsure' THEN 'Unclear' ELSE overall_status END AS fact_myth_status,
              '{RUN_TS:%Y-%m-%d %H:%M:%S}' AS created_at, article_id AS seq
            FROM page_summaries JOIN page_votes USING (article_id) JOIN page_category USING (article_id)""",
            "page_summaries", "page_votes", "page_category",
        ),
        "stream_session_rows": statement(
            f"""
            SELECT 'pages' AS topic, count(*) AS articles_found, count(*) FILTER (overall_status = 'Fact') AS facts_count,
              count(*) FILTER (overall_status = 'Myth') AS myths_count, count(*) FILTER (overall_status = 'Unsure') AS unclear_count,
              '{RUN_TS:%Y-%m-%d %H:%M:%S}' AS created_at
            FROM page_votes""",
            "page_votes",
        ),
        "failed_lookups": statement(
            """
            SELECT * EXCLUDE (facts, myths, unsure), CASE WHEN facts > myths AND facts > unsure THEN 'Fact' WHEN myths > facts AND myths > unsure THEN 'Myth'
                ELSE 'Unsure' END AS overall_status
            FROM (SELECT article_id, pos, claim, CASE WHEN f THEN 'Unsure' ELSE status END AS status,
                CASE WHEN f THEN 'Error occurred' ELSE rating END AS rating, CASE WHEN f THEN 'None' ELSE publisher END AS publisher,
                CASE WHEN f THEN '' ELSE publisher_site END AS publisher_site, CASE WHEN f THEN '' ELSE review_url END AS review_url,
                CASE WHEN f THEN '' ELSE review_date END AS review_date, CASE WHEN f THEN 'low' ELSE confidence END AS confidence
              FROM (SELECT *, (article_id + pos) % 7 = 3 AS f FROM results))
            JOIN (SELECT article_id, count(*) FILTER (NOT f AND status = 'Fact') AS facts,
                count(*) FILTER (NOT f AND status = 'Myth') AS myths, count(*) FILTER (f OR status = 'Unsure') AS unsure
              FROM (SELECT *, (article_id + pos) % 7 = 3 AS f FROM results) GROUP BY article_id) USING (article_id)""",
            "results",
        ),
        "votes_without_reviews": statement(
            "SELECT article_id, 0 AS claim_count, 0 AS fact_count, 0 AS myth_count, 0 AS unsure_count, 'Unsure' AS overall_status FROM articles",
            "articles",
        ),
        "store_log": statement("SELECT * FROM current_rows", "current_rows"),
        "publish_options": statement(
            "SELECT o.field, option, position, count(value) AS n FROM (VALUES "
            + ", ".join(f"('{f}', '{o}', {i})" for f, options in publish.OPTIONS.items() for i, o in enumerate(options, 1))
            + """) o (field, option, position) LEFT JOIN (
                SELECT 'Fact Status' AS field, "Fact Status" AS value FROM published
                UNION ALL SELECT 'Classification', "Classification" FROM published
                UNION ALL SELECT 'Confidence', "Confidence" FROM published) p ON p.field = o.field AND p.value = o.option
            GROUP BY ALL""",
            "published",
        ),
        "json_export": statement(
            """
            SELECT article_id, url, array_to_string(key_claims, ' | ') AS claims, classification,
              CASE fact_myth_status WHEN 'Unclear' THEN 'Unsure' ELSE fact_myth_status END AS overall_fact_status
            FROM analysed""",
            "analysed",
        ),
    }
