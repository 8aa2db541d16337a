"""DuckDB SQL for the registered queries.

DuckDB's levenshtein counts bytes, so texts are first mapped one to one into single-byte characters; the given tables hold
21 letters beyond ASCII, and no control characters.
"""

from __future__ import annotations

from .queries import misread

FOREIGN = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
SINGLE = "".join(map(chr, [*range(1, 9), *range(14, 27)]))


def b(x: str) -> str:
    return f"translate({x}, '{FOREIGN}', '{SINGLE}')"


def lev(x: str, y: str) -> str:
    return f"levenshtein({b(x)}, {b(y)})"


def n1(x: str) -> str:
    return f"trim(regexp_replace(lower(translate({x}, 'ÄÈÉÊÍÓÖÜäèéêíóöü', 'AEEEIOOUaeeeioou')), '\\s+', ' ', 'g'))"


def key(x: str) -> str:
    return f"trim(lower(translate({x}, 'ÄÈÉÊÍÓÖÜäèéêíóöü', 'AEEEIOOUaeeeioou')))"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda x: x <> '')"


def swap(x: str) -> str:
    return f"translate({x}, 'uvfsUVFS', 'vusfVUSF')"


WORDS = "regexp_extract_all({}, '[A-Za-zÀ-ÿ]+')"
LINES = f"""
    t AS MATERIALIZED (SELECT doc_id, lang, {toks("text")} AS t FROM documents),
    i AS MATERIALIZED (SELECT doc_id, lang, t, unnest(range(0, len(t), 12)) AS i FROM t),
    lines AS MATERIALIZED (SELECT doc_id, lang, CAST(i // 12 AS INTEGER) AS line_no, array_to_string(t[CAST(i + 1 AS BIGINT):CAST(i + 12 AS BIGINT)], ' ') AS line FROM i),
    pairs AS MATERIALIZED (SELECT *, {swap("line")} AS pred FROM lines)
"""
TURNS = f"""
    g AS (SELECT conv_id AS page_id, CAST(turn AS INTEGER) AS gt_idx, text AS gt FROM conversations),
    p AS (SELECT conv_id AS page_id, CASE WHEN turn = 0 THEN 1 ELSE CAST(turn AS INTEGER) END AS pred_idx, {swap("text")} AS pred FROM conversations WHERE turn <> 1
          UNION ALL SELECT conv_id, 0, 'X ' || role FROM conversations WHERE turn = 0)
"""
SPANISH = f"es AS MATERIALIZED (SELECT DISTINCT {key('w')} AS word FROM (SELECT unnest({WORDS.format('text')}) AS w FROM documents WHERE lang = 'es'))"
FRENCH = f"known AS MATERIALIZED (SELECT DISTINCT {key('w')} AS word FROM (SELECT unnest({WORDS.format('text')}) AS w FROM documents WHERE lang = 'fr'))"
COUNTS = f"c AS (SELECT lang, {key('w')} AS word, count(*) AS n FROM (SELECT lang, unnest({WORDS.format('text')}) AS w FROM documents) GROUP BY ALL)"


READ = "readings(kind, place, seen, read) AS (VALUES " + ", ".join(f"('{k}', {i}, '{a}', '{b}')" for k, i, a, b in misread()) + ")"


def number(first: int, n: int) -> str:
    return f"CAST('0x' || substr(h, {first}, {n}) AS BIGINT)"


def pairs_from_left(src: str) -> str:
    """Of places (rid, i, c, own, two, pair), the text of each rid, where a standing pair takes the place behind it along.

    In a run of places that want to begin a pair, every other one does.
    """
    return f"""
        {src}_run AS (SELECT rid, i, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS run FROM {src} WHERE pair),
        {src}_first AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY rid, run ORDER BY i) AS k FROM {src}_run) WHERE k % 2 = 1),
        {src}_out AS (SELECT s.rid, string_agg(CASE WHEN f.i IS NOT NULL THEN s.two WHEN g.i IS NOT NULL THEN '' ELSE s.own END, '' ORDER BY s.i) AS noisy
            FROM {src} s LEFT JOIN {src}_first f ON f.rid = s.rid AND f.i = s.i LEFT JOIN {src}_first g ON g.rid = s.rid AND g.i + 1 = s.i GROUP BY s.rid)"""


#: From src(rid, txt, salt): word_out, old_out and edit_out(rid, noisy).
NOISE = f"""
    {READ}, one AS (SELECT kind, seen, arg_min(read, place) AS read FROM readings GROUP BY kind, seen),
    ch AS MATERIALIZED (SELECT rid, i, c[i + 1] AS c, c[i + 2] AS after, md5(salt || '|' || i) AS h FROM (SELECT rid, salt, c, unnest(range(0, len(c))) AS i FROM (SELECT rid, salt, string_split(txt, '') AS c FROM src))),
    w AS (SELECT rid, j, w[j + 1] AS w, length(w[j + 1]) AS n, md5(salt || '|' || j) AS h FROM (SELECT rid, salt, w, unnest(range(0, len(w))) AS j FROM (SELECT rid, salt, string_split(txt, ' ') AS w FROM src))),
    p AS (SELECT *, {number(1, 8)} % n AS a, CASE WHEN n > 1 AND substr(h, 9, 1) >= '8' THEN ({number(1, 8)} % n + 1 + {number(10, 7)} % (n - 1)) % n END AS b FROM w),
    l AS (SELECT rid, j, i, c, a, b, h, instr('abcdefghijklmnopqrstuvwxyz', lower(c)) AS k, CASE WHEN i = a THEN {number(17, 8)} ELSE {number(25, 8)} END AS u
          FROM (SELECT *, unnest(string_split(w, '')) AS c, generate_subscripts(string_split(w, ''), 1) - 1 AS i FROM p)),
    o AS (SELECT *, substr('abcdefghijklmnopqrstuvwxyz', CASE WHEN c <> '' AND k > 0 THEN (k + u % 25) % 26 ELSE u % 26 END + 1, 1) AS other FROM l),
    ww AS (SELECT rid, j, string_agg(CASE WHEN c <> '' AND (i = a OR i = coalesce(b, -1)) THEN coalesce(t.read, CASE WHEN c = lower(c) THEN other ELSE upper(other) END) ELSE c END, '' ORDER BY i) AS w
           FROM o LEFT JOIN one t ON t.kind = 'word' AND t.seen = c GROUP BY rid, j),
    word_out AS (SELECT rid, string_agg(w, ' ' ORDER BY j) AS noisy FROM ww GROUP BY rid),
    cand AS (SELECT rid, i, read, length(seen) AS size, row_number() OVER (PARTITION BY rid, i ORDER BY place) - 1 AS nth, {number(1, 8)} AS x FROM ch JOIN readings ON kind = 'type' AND (seen = c OR seen = c || after)),
    hit AS (SELECT * FROM cand WHERE x < floor((1 - pow(0.88, nth + 1)) * 4294967296) AND (nth = 0 OR x >= floor((1 - pow(0.88, nth)) * 4294967296))),
    old AS MATERIALIZED (SELECT ch.rid, ch.i, CASE WHEN size = 1 THEN read WHEN {number(9, 8)} < floor(0.03 * 4294967296) THEN c || c WHEN c = ' ' AND {number(17, 8)} < floor(0.04 * 4294967296) THEN '' ELSE c END AS own,
                   read AS two, coalesce(size = 2, false) AS pair FROM ch LEFT JOIN hit ON hit.rid = ch.rid AND hit.i = ch.i),
    {pairs_from_left("old")},
    e AS (SELECT ch.*, {number(1, 8)} / 4294967296.0::DOUBLE AS x, t.read AS same, s.read AS small FROM ch LEFT JOIN one t ON t.kind = 'edit' AND t.seen = c LEFT JOIN one s ON s.kind = 'edit' AND s.seen = lower(c)),
    f AS (SELECT *, CASE WHEN x < 0.0075 THEN '' WHEN x < 0.015 THEN c || substr('abcdefghijklmnopqrstuvwxyz', {number(9, 8)} % 26 + 1, 1)
                         WHEN x < 0.0225 AND coalesce(same, small) IS NOT NULL THEN CASE WHEN c = lower(c) THEN coalesce(same, small) ELSE upper(coalesce(same, small)) END END AS own0 FROM e),
    edit AS MATERIALIZED (SELECT rid, i, coalesce(own0, c) AS own, after || c AS two, own0 IS NULL AND x < 0.03 AND after IS NOT NULL AS pair FROM f),
    {pairs_from_left("edit")}
"""
COPIES = "src AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, concat_ws('|', '42', conv_id, turn, copy) AS salt FROM (SELECT conv_id, turn, {0} AS txt, unnest(range(0, 5)) AS copy FROM conversations))"
MIXED = """mixed AS (SELECT s.*, CASE WHEN x < floor(0.33 * 4294967296) THEN w.noisy WHEN x < floor(0.66 * 4294967296) THEN o.noisy ELSE e.noisy END AS noisy
    FROM (SELECT *, CAST('0x' || substr(md5(salt || '|kind'), 1, 8) AS BIGINT) AS x FROM src) s JOIN word_out w USING (rid) JOIN old_out o USING (rid) JOIN edit_out e USING (rid))"""


def times(x: str, y: str) -> str:
    return f"len(list_filter({x}, lambda q: q = {y}))"


def grams(x: str, n: int) -> str:
    parts = " || chr(1) || ".join(f"{x}[i + {k}]" for k in range(n))
    return f"list_transform(range(1, len({x}) - {n - 2}), lambda i: {parts})"


def _bleu() -> str:
    logs = []
    for n in range(1, 5):
        match = f"list_sum(list_transform(list_distinct(h{n}), lambda y: least(len(list_filter(h{n}, lambda q: q = y)), len(list_filter(r{n}, lambda q: q = y)))))"
        logs.append(f"ln((coalesce({match}, 0) + 1.0) / (greatest(len(h{n}), 1) + 1.0))")
    return f"CASE WHEN len(h) = 0 OR len(r) = 0 THEN 0.0 ELSE least(1.0, exp(1.0 - len(r) / greatest(len(h), 1))) * exp(({' + '.join(logs)}) / 4) END"


def variants(x: str, low: str, most: int = 5) -> str:
    """All spellings, as a list: the product of each character's choices."""
    a, z = low
    choices = f"list_transform(list_filter(regexp_split_to_array({x}, ''), lambda k: k <> ''), lambda k: CASE WHEN k IN ('{a}', '{z}') THEN ['{a}', '{z}'] WHEN k IN ('{a.upper()}', '{z.upper()}') THEN ['{a.upper()}', '{z.upper()}'] ELSE [k] END)"
    product = f"list_reduce({choices}, lambda s, o: flatten(list_transform(s, lambda m: list_transform(o, lambda e: m || e))), [''])"
    places = f"length(regexp_replace({x}, '[^{low}{low.upper()}]', '', 'g'))"
    return f"CASE WHEN {places} BETWEEN 1 AND {most} THEN {product} ELSE [{x}] END"


CORRECTIONS = f"""
    d AS MATERIALIZED (SELECT DISTINCT token FROM tok),
    e AS (SELECT token, regexp_replace(token, '[^A-Za-zÀ-ÿ]', '', 'g') AS letters, regexp_extract(token, '^([^A-Za-zÀ-ÿ]*)', 1) AS pre,
                 regexp_extract(token, '^[^A-Za-zÀ-ÿ]*(.*?)[^A-Za-zÀ-ÿ]*$', 1) AS core, regexp_extract(token, '[A-Za-zÀ-ÿ]([^A-Za-zÀ-ÿ]*)$', 1) AS post FROM d),
    o AS MATERIALIZED (SELECT * FROM e WHERE length(letters) >= 2 AND {key("letters")} NOT IN (SELECT word FROM known)),
    u AS MATERIALIZED (SELECT core, min(v) AS uv FROM (SELECT DISTINCT core, unnest({variants("core", "uv")}) AS v FROM o) WHERE v <> core AND {key("v")} IN (SELECT word FROM known) GROUP BY core),
    o2 AS MATERIALIZED (SELECT o.*, u.uv, coalesce(u.uv, o.core) AS base FROM o LEFT JOIN u ON u.core = o.core),
    f AS MATERIALIZED (SELECT base, min(v) AS fs FROM (SELECT DISTINCT base, unnest({variants("base", "fs")}) AS v FROM o2) WHERE v <> base AND {key("v")} IN (SELECT word FROM known) GROUP BY base),
    o3 AS MATERIALIZED (SELECT o2.*, f.fs FROM o2 LEFT JOIN f ON f.base = o2.base),
    m1 AS MATERIALIZED (SELECT DISTINCT core, unnest({variants("core", "uv")}) AS v1 FROM o3 WHERE uv IS NULL AND fs IS NULL),
    m AS MATERIALIZED (SELECT core, min(v) AS both FROM (SELECT core, unnest({variants("v1", "fs")}) AS v FROM m1) WHERE v <> core AND {key("v")} IN (SELECT word FROM known) GROUP BY core),
    fix AS MATERIALIZED (SELECT o3.token, coalesce(pre || coalesce(fs, uv, m."both") || post, o3.token) AS corrected FROM o3 LEFT JOIN m ON m.core = o3.core)
"""


def _pair_metric(name: str, value: str, extra: str = "") -> str:
    return f"WITH {LINES}{extra} SELECT lang, round(avg({value}), 9) AS {name}, count(*) AS lines FROM pairs2 GROUP BY lang" if extra else f"WITH {LINES} SELECT lang, round(avg({value}), 9) AS {name}, count(*) AS lines FROM pairs GROUP BY lang"


NS = "translate({}, ' ' || chr(10), '')"
LISTS = f", l AS (SELECT lang, {toks('pred')} AS h, {toks('line')} AS r FROM pairs)"
CODED = ", k AS (SELECT *, list_distinct(list_concat(h, r)) AS d FROM l), pairs2 AS (SELECT lang, array_to_string(list_transform(h, lambda w: chr(CAST(list_position(d, w) + 40 AS INTEGER))), '') AS p, array_to_string(list_transform(r, lambda w: chr(CAST(list_position(d, w) + 40 AS INTEGER))), '') AS q FROM k)"
BLEU_LISTS = f", k AS (SELECT *, {', '.join(f'{grams(x, n)} AS {x}{n}' for x in 'hr' for n in range(1, 5))} FROM l), pairs2 AS (SELECT * FROM k)"
SQUARE = "list_sum(list_transform(list_distinct({0}), lambda w: len(list_filter({0}, lambda q: q = w)) * len(list_filter({0}, lambda q: q = w))))"
BAG = f"CASE WHEN len(h) = 0 AND len(r) = 0 THEN 1.0 WHEN len(h) = 0 OR len(r) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_intersect(list_distinct(h), list_distinct(r)), lambda w: len(list_filter(h, lambda q: q = w)) * len(list_filter(r, lambda q: q = w)))), 0) / (sqrt({SQUARE.format('h')}) * sqrt({SQUARE.format('r')})) END"


def _tfidf(terms: str) -> str:
    return f"""
WITH c AS (SELECT conv_id || '-' || turn AS k, role, text AS a, {swap("text")} AS b FROM conversations),
     s AS (SELECT k, 0 AS side, {terms.replace("$", "a")} AS t FROM c UNION ALL SELECT k, 1, {terms.replace("$", "b")} FROM c),
     tf AS (SELECT k, side, term, count(*) AS tf FROM (SELECT k, side, unnest(t) AS term FROM s) GROUP BY ALL),
     idf AS (SELECT term, ln((1 + (SELECT 2 * count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
     w AS (SELECT k, term, coalesce(sum(tf * idf) FILTER (side = 0), 0) AS x, coalesce(sum(tf * idf) FILTER (side = 1), 0) AS y FROM tf JOIN idf USING (term) GROUP BY k, term),
     r AS (SELECT k, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS cosine FROM w GROUP BY k)
SELECT role, round(avg(coalesce(CASE WHEN isnan(cosine) THEN 0 ELSE cosine END, 0)), 9) AS cosine, count(*) AS turns FROM c LEFT JOIN r USING (k) GROUP BY role
"""


WORDPUNCT = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+')"
BLEU_COUNTS = ", l AS (SELECT lang, " + WORDPUNCT.format("pred") + " AS h, " + WORDPUNCT.format("line") + " AS r FROM pairs), k AS (SELECT *, " + ", ".join(f"{grams(x, n)} AS {x}{n}" for x in "hr" for n in range(1, 5)) + " FROM l)"


def _match(n: int) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(h{n}), lambda y: least(len(list_filter(h{n}, lambda q: q = y)), len(list_filter(r{n}, lambda q: q = y))))), 0)"


BLEU_SUMS = ", s AS (SELECT lang, count(*) AS lines, sum(len(h)) AS hs, sum(len(r)) AS rs, " + ", ".join(f"sum({_match(n)}) AS m{n}, sum(len(h{n})) AS t{n}" for n in range(1, 5)) + " FROM k GROUP BY lang)"


def nw(pred: str = "pred") -> str:
    """The cheapest alignment of each page's turns: cells of the table one after another, then the way back."""
    return f"""
    pp AS (SELECT page_id, list({pred} ORDER BY pred_idx) AS p FROM p GROUP BY page_id), gg AS (SELECT page_id, list(gt ORDER BY gt_idx) AS g FROM g GROUP BY page_id),
    pages AS MATERIALIZED (SELECT pp.page_id, p, coalesce(g, []) AS g, len(p) AS n, coalesce(len(g), 0) AS m FROM pp LEFT JOIN gg USING (page_id)),
    ij AS (SELECT page_id, p, g, i, unnest(range(1, m + 1)) AS j FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM pages)),
    d AS MATERIALIZED (SELECT page_id, list({lev("lower(p[i])", "lower(g[j])")} ORDER BY i, j) AS d FROM ij GROUP BY page_id),
    q AS MATERIALIZED (SELECT pages.*, d FROM pages LEFT JOIN d USING (page_id)),
    f(page_id, k, c, o) AS (SELECT page_id, CAST(1 AS BIGINT), [CAST(0 AS BIGINT)], [CAST(0 AS BIGINT)] FROM q UNION ALL
        SELECT page_id, k + 1, list_append(c, CAST(CASE o2 WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END AS BIGINT)), list_append(o, CAST(o2 AS BIGINT)) FROM (
            SELECT *, CASE WHEN a0 <= a1 AND a0 <= a2 THEN 0 WHEN a1 <= a2 THEN 1 ELSE 2 END AS o2 FROM (
                SELECT f.page_id, k, c, o,
                    CASE WHEN k // (m + 1) > 0 AND k % (m + 1) > 0 THEN c[k - m - 1] + d[(k // (m + 1) - 1) * m + k % (m + 1)] ELSE 1e9 END AS a0,
                    CASE WHEN k // (m + 1) > 0 THEN c[k - m] + length(p[k // (m + 1)]) ELSE 1e9 END AS a1,
                    CASE WHEN k % (m + 1) > 0 THEN c[k] + length(g[k % (m + 1)]) ELSE 1e9 END AS a2
                FROM f JOIN q USING (page_id) WHERE k < (n + 1) * (m + 1)))),
    done AS MATERIALIZED (SELECT q.*, c, o FROM f JOIN q USING (page_id) WHERE k = (n + 1) * (m + 1)),
    b(page_id, i, j, op) AS (SELECT page_id, n, m, o[n * (m + 1) + m + 1] FROM done UNION ALL
        SELECT page_id, i2, j2, o[i2 * (m + 1) + j2 + 1] FROM (SELECT b.page_id, m, o, CASE WHEN op <> 2 THEN i - 1 ELSE i END AS i2, CASE WHEN op <> 1 THEN j - 1 ELSE j END AS j2 FROM b JOIN done USING (page_id) WHERE i > 0 OR j > 0)),
    steps AS (SELECT b.page_id, i, j, op, p[i] AS t, CASE WHEN op = 0 THEN g[j] ELSE '' END AS x, c[len(c)] AS cost FROM b JOIN done USING (page_id) WHERE (i > 0 OR j > 0) AND op <> 2),
    al AS MATERIALIZED (SELECT page_id, CAST(i - 1 AS INTEGER) AS pred_idx, t AS pred_text, x AS matched_gt, CAST(CASE WHEN op = 0 THEN j - 1 ELSE -1 END AS INTEGER) AS matched_gt_idx,
        CAST(CASE WHEN op = 0 THEN {lev("lower(t)", "lower(x)")} ELSE length(t) END AS INTEGER) AS edit_distance, op = 0 AND i <> j AS was_shifted, op = 1 AS skipped, CAST(cost AS INTEGER) AS path_cost FROM steps),
    aligned AS MATERIALIZED (SELECT page_id, pred_idx, pred_text, matched_gt, matched_gt_idx, edit_distance, round_even(edit_distance / greatest(length(matched_gt), 1), 4) AS cer, was_shifted, skipped, path_cost FROM al)
"""


WORD_TERMS = "list_filter(regexp_extract_all(lower($), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 1)"
CHAR_TERMS = "flatten(list_transform(list_filter(regexp_split_to_array(lower($), '\\s+'), lambda w: w <> ''), lambda w: flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, CAST(length(w) + 4 - n AS BIGINT)), lambda i: substr(' ' || w || ' ', i, n))))))"

ORACLE = {
    "accent_norm_n1": f"SELECT doc_id, md5({n1('text')}) AS digest, length({n1('text')}) AS length FROM documents",
    "accent_norm_n2": "SELECT doc_id, md5(lower(strip_accents(text))) AS digest, length(lower(strip_accents(text))) AS length FROM documents",
    "words_distinct": f"WITH {COUNTS} SELECT lang, count(*) AS words, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY lang",
    "oov_rate": f"WITH {COUNTS}, {SPANISH}, r AS (SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (word NOT IN (SELECT word FROM es)), 0) AS BIGINT) AS unknown FROM c GROUP BY lang) SELECT *, unknown / tokens AS rate FROM r",
    "cedilla_rule": f"WITH {LINES} SELECT lang, count(*) AS lines, count(*) FILTER (contains(line, 'ç') OR contains(line, 'Ç')) AS changed FROM lines GROUP BY lang",
    "uv_fs_variants": f"""WITH w AS (SELECT DISTINCT lang, w FROM (SELECT lang, unnest({WORDS.format('text')}) AS w FROM documents)),
        k AS (SELECT lang, length(regexp_replace(w, '[^uvUV]', '', 'g')) AS u, length(regexp_replace(w, '[^fsFS]', '', 'g')) AS f FROM w)
        SELECT lang, CAST(sum(CASE WHEN u BETWEEN 1 AND 5 THEN 1 << u ELSE 1 END) AS BIGINT) AS uv, CAST(sum(CASE WHEN f BETWEEN 1 AND 5 THEN 1 << f ELSE 1 END) AS BIGINT) AS fs, count(*) AS words FROM k GROUP BY lang""",
    "apply_rules": f"""WITH {LINES}, {FRENCH}, tok AS MATERIALIZED (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({toks("translate(pred, 'çÇ', 'zZ')")}) AS token FROM pairs) GROUP BY ALL), {CORRECTIONS},
        x AS (SELECT tok.*, coalesce(fix.corrected, tok.token) AS corrected FROM tok LEFT JOIN fix USING (token))
        SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (corrected <> token), 0) AS BIGINT) AS changed, CAST(coalesce(sum(n) FILTER (corrected <> token AND corrected = {swap("token")}), 0) AS BIGINT) AS restored FROM x GROUP BY lang""",
    "rules_on_lines": f"""WITH {LINES}, {FRENCH}, parts AS MATERIALIZED (SELECT doc_id, line_no, unnest(x) AS token, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, line_no, string_split(translate(pred, 'çÇ', 'zZ'), ' ') AS x FROM pairs)), tok AS (SELECT token FROM parts), {CORRECTIONS},
        y AS (SELECT doc_id, line_no, string_agg(coalesce(fix.corrected, parts.token), ' ' ORDER BY pos) AS corrected FROM parts LEFT JOIN fix USING (token) GROUP BY ALL)
        SELECT count(*) AS lines, count(*) FILTER (corrected <> pred) AS changed, CAST(sum({lev("pred", "line")}) AS BIGINT) AS edits_before, CAST(sum({lev("corrected", "line")}) AS BIGINT) AS edits_after, CAST(sum(length(line)) AS BIGINT) AS ref_len FROM pairs JOIN y USING (doc_id, line_no)""",
    "cer_micro_by_lang": f"WITH {LINES}, d AS (SELECT lang, CAST(sum({lev(n1('pred'), n1('line'))}) AS BIGINT) AS edits, CAST(sum(length({n1('line')})) AS BIGINT) AS ref_len FROM pairs GROUP BY lang) SELECT *, edits / greatest(ref_len, 1) AS cer FROM d",
    "cer_macro_by_lang": _pair_metric("cer", f"{lev('pred', 'line')} / greatest(length(line), 1)"),
    "cer_spacefree": _pair_metric("rate", f"{lev(NS.format('pred'), NS.format('line'))} / greatest(length({NS.format('pred')}), length({NS.format('line')}), 1)"),
    "wer_pair": _pair_metric("rate", f"levenshtein(p, q) / greatest(length(p), length(q), 1)", LISTS + CODED),
    "bleu_sentence": _pair_metric("bleu", _bleu(), LISTS + BLEU_LISTS),
    "jaccard": _pair_metric("jaccard", "len(list_intersect(list_distinct(h), list_distinct(r))) / greatest(len(list_distinct(list_concat(h, r))), 1)", LISTS + ", pairs2 AS (SELECT * FROM l)"),
    "cosine_counts": _pair_metric("cosine", "CASE WHEN len(h) = 0 AND len(r) = 0 THEN NULL ELSE " + BAG[BAG.index("WHEN len(h) = 0 OR"):].replace("WHEN", "CASE WHEN", 1) + " END", f", l AS (SELECT lang, {WORD_TERMS.replace('$', 'pred')} AS h, {WORD_TERMS.replace('$', 'line')} AS r FROM pairs), pairs2 AS (SELECT * FROM l)"),
    "metric_bundle": f"""WITH {LINES}, l AS (SELECT lang, pred, line, {toks('pred')} AS ht, {toks('line')} AS rt, {WORD_TERMS.replace('$', 'pred')} AS h, {WORD_TERMS.replace('$', 'line')} AS r FROM pairs), k AS (SELECT *, list_distinct(list_concat(ht, rt)) AS d FROM l),
        m AS (SELECT lang, round_even({lev(NS.format('pred'), NS.format('line'))} / greatest(length({NS.format('pred')}), length({NS.format('line')}), 1), 4) AS cer,
            round_even(levenshtein(array_to_string(list_transform(ht, lambda w: chr(CAST(list_position(d, w) + 40 AS INTEGER))), ''), array_to_string(list_transform(rt, lambda w: chr(CAST(list_position(d, w) + 40 AS INTEGER))), '')) / greatest(len(ht), len(rt), 1), 4) AS wer,
            round_even(CASE WHEN len(h) = 0 AND len(r) = 0 THEN NULL ELSE {BAG} END, 4) AS cosine FROM k)
        SELECT lang, round(avg(cer), 9) AS cer, round(avg(wer), 9) AS wer, round(avg(cosine), 9) AS cosine FROM m GROUP BY lang""",
    "cosine_bow": _pair_metric("cosine", BAG, LISTS + ", pairs2 AS (SELECT * FROM l)"),
    "tfidf_cosine_word": _tfidf(WORD_TERMS),
    "tfidf_cosine_charwb": _tfidf(CHAR_TERMS),
    "wordcount_guard": f"""WITH c AS (SELECT role, text, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), text) AS nxt FROM conversations),
        d AS (SELECT role, trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' AS blank, abs(len({toks("text")}) - len({toks("nxt")})) AS diff FROM c)
        SELECT role, CASE WHEN blank THEN 'empty_input' WHEN diff = 0 THEN 'success' ELSE 'word_count_mismatch' END AS exact, CASE WHEN blank THEN 'empty_input' WHEN diff <= 2 THEN 'success' ELSE 'word_count_mismatch' END AS loose, count(*) AS turns FROM d GROUP BY ALL""",
    "positional_outer": f"WITH {TURNS} SELECT p.page_id, pred_idx AS pos, pred, coalesce(gt, '') AS gt, gt IS NOT NULL AS matched FROM p LEFT JOIN g ON g.page_id = p.page_id AND gt_idx = pred_idx",
    "positional_anti": f"WITH {TURNS}, l AS (SELECT page_id, max(gt_idx) AS last FROM g GROUP BY page_id) SELECT page_id, gt_idx AS pos, gt FROM g WHERE NOT EXISTS (SELECT 1 FROM p JOIN l USING (page_id) WHERE p.page_id = g.page_id AND pred_idx = gt_idx AND pred_idx < last)",
    "nw_align": f"WITH RECURSIVE {TURNS}, {nw()} SELECT * FROM aligned",
    "quota_stage": f"SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_input' ELSE 'success' END AS status, md5({swap('text')}) AS digest, CAST(1 AS BIGINT) AS most_requests FROM conversations",
    "stream_align": f"WITH RECURSIVE {TURNS}, {nw()} SELECT *, true AS complete FROM aligned",
    "aggregate_cer": f"""WITH RECURSIVE {TURNS}, {nw()}, s AS (SELECT page_id, CAST(coalesce(sum(edit_distance) FILTER (NOT skipped), 0) AS BIGINT) AS edits, CAST(coalesce(sum(greatest(length(matched_gt), 1)) FILTER (NOT skipped), 0) AS BIGINT) AS ref_len,
        round(coalesce(avg(cer) FILTER (NOT skipped), 0), 9) AS mean_line_cer, count(*) FILTER (was_shifted) AS shifted, count(*) FILTER (skipped) AS skipped, count(*) AS total FROM aligned GROUP BY page_id) SELECT *, edits / greatest(ref_len, 1) AS total_cer FROM s""",
    "exclusion_report": f"""WITH RECURSIVE {TURNS}, {nw()}, r AS (SELECT {lev("pred_text", "matched_gt")} / greatest(length(matched_gt), 1) AS r FROM aligned WHERE NOT skipped AND matched_gt <> '')
        SELECT round(coalesce(avg(r), 0), 9) AS all_cer, round(coalesce(avg(r) FILTER (r <= 0.80), 0), 9) AS kept_cer, count(*) FILTER (r > 0.80) AS n_excluded, count(*) AS lines FROM r""",
    "stage_rates": f"""WITH RECURSIVE {TURNS}, {nw(swap("pred"))}, n AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pred_idx) - 1 AS INTEGER) AS pred_idx, pred FROM p),
        x AS (SELECT matched_gt AS g, {lev(swap("pred"), "matched_gt")} / greatest(length(matched_gt), 1) > 0.80 AS out, unnest(['raw', 'rules', 'final']) AS stage, unnest([pred, translate(pred, 'çÇ', 'zZ'), {swap("pred")}]) AS t FROM aligned JOIN n USING (page_id, pred_idx) WHERE NOT skipped AND matched_gt <> ''),
        r AS (SELECT stage, out, {lev("t", "g")} / greatest(length(g), 1) AS r, {lev(n1("t"), n1("g"))} / greatest(length({n1("g")}), 1) AS q FROM x)
        SELECT stage, round(coalesce(avg(r) FILTER (NOT out), 0), 9) AS cer, round(coalesce(avg(q) FILTER (NOT out), 0), 9) AS norm_cer, count(*) FILTER (NOT out) AS lines, count(*) FILTER (out) AS excluded FROM r GROUP BY stage""",
    "improvement_flags": f"""WITH {LINES}, r AS (SELECT lang, round_even({lev("pred", "line")} / greatest(length(line), 1), 3) AS a, round_even({lev("translate(pred, 'çÇ', 'zZ')", "line")} / greatest(length(line), 1), 3) AS b FROM pairs)
        SELECT lang, CASE WHEN b < a THEN 'better' WHEN b = a THEN 'same' ELSE 'worse' END AS flag, count(*) AS lines FROM r GROUP BY ALL""",
    "wer_corpus": f"""WITH {LINES}, c AS (SELECT lang, round(sum({lev("pred", "line")}) / greatest(sum(length(line)), 1), 9) AS cer FROM pairs GROUP BY lang) {LISTS + CODED}, w AS (SELECT lang, round(sum(levenshtein(p, q)) / greatest(sum(length(q)), 1), 9) AS wer FROM pairs2 GROUP BY lang)
        SELECT lang, cer, wer FROM c JOIN w USING (lang)""",
    "bleu_corpus": f"WITH {LINES}{BLEU_COUNTS}{BLEU_SUMS} SELECT lang, round(CASE WHEN least(m1, m2, m3, m4) = 0 THEN 0 ELSE least(1.0, exp(1.0 - rs / hs)) * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4) END, 9) AS bleu, lines FROM s",
    "stage_report": f"""WITH {LINES}, x AS (SELECT line, unnest(['raw', 'rules']) AS stage, unnest([pred, translate(pred, 'çÇ', 'zZ')]) AS x FROM pairs), l AS (SELECT stage, line, x, {toks("x")} AS h, {toks("line")} AS r FROM x), k AS (SELECT *, list_distinct(list_concat(h, r)) AS d FROM l),
        y AS (SELECT stage, {lev("x", "line")} AS e, length(line) AS n, levenshtein(array_to_string(list_transform(h, lambda w: chr(CAST(list_position(d, w) + 40 AS INTEGER))), ''), array_to_string(list_transform(r, lambda w: chr(CAST(list_position(d, w) + 40 AS INTEGER))), '')) AS we, len(r) AS wn FROM k),
        s AS (SELECT stage, round(sum(e) / greatest(sum(n), 1), 9) AS cer, round(sum(we) / greatest(sum(wn), 1), 9) AS wer, CAST(count(*) AS DOUBLE) AS lines FROM y GROUP BY stage)
        SELECT stage, unnest(['cer', 'wer', 'lines']) AS metric, unnest([cer, wer, lines]) AS value FROM s""",
    "run_summary": f"""WITH {TURNS}, x AS (SELECT page_id, pred_idx AS pos, 1 AS x, 0 AS y FROM p WHERE pred_idx <> 2 UNION ALL SELECT page_id, gt_idx, 0, 1 FROM g), s AS (SELECT page_id, pos, sum(x) AS x, sum(y) AS y FROM x GROUP BY ALL)
        SELECT page_id, CAST(sum(x) AS BIGINT) AS image_lines, CAST(sum(y) AS BIGINT) AS text_lines, CAST(sum(least(x, y)) AS BIGINT) AS matched, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS unmatched_image, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS unmatched_text FROM s GROUP BY ROLLUP (page_id)""",
    "skipped_folders": """WITH i AS (SELECT page_id AS id, max(length(html) >= 200) AS ok FROM pages GROUP BY ALL), t AS (SELECT DISTINCT doc_id AS id, true AS has FROM documents)
        SELECT * FROM (SELECT coalesce(i.id, t.id) AS id, CASE WHEN ok IS NULL THEN 'no image' WHEN has IS NULL THEN 'no text' WHEN NOT ok THEN 'unreadable' END AS reason FROM i FULL JOIN t ON i.id = t.id) WHERE reason IS NOT NULL""",
    "first_lines": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines ORDER BY doc_id, line_no LIMIT 19",
    "token_spans": r"""WITH x AS (SELECT conv_id, turn, regexp_extract_all(text, '\s+|\S+') AS t FROM conversations), u AS (SELECT conv_id, turn, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM x),
        s AS (SELECT conv_id, turn, t, sum(length(t)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS e FROM u) SELECT conv_id, turn, count(*) AS tokens, CAST(sum(e - length(t)) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM s WHERE NOT regexp_full_match(t, '\s+') GROUP BY conv_id, turn""",
    "spelling_errors": f"WITH {LINES}, z AS (SELECT unnest({toks('pred')}) AS original, unnest({toks('line')}) AS corrected FROM pairs) SELECT corrected, original, count(*) AS n FROM z WHERE corrected <> original GROUP BY ALL",
    "nested_forms": f"WITH {LINES}, z AS (SELECT unnest({toks('line')}) AS corrected FROM lines) SELECT corrected, 1 AS forms, count(*) AS n FROM z GROUP BY corrected",
    "page_split": "SELECT CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), '42')), 1, 13) AS BIGINT) < 900719925474099 AS val, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL",
    "ink_levels": "SELECT user_id AS page_id, round(quantile_cont(value, 0.10), 6) AS p10, round(quantile_cont(value, 0.20), 6) AS p20, round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY user_id",
    "cut_segments": """WITH s AS (SELECT user_id AS page_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS y, value AS ink FROM events),
        c AS (SELECT *, count(*) FILTER (ink < 12) OVER (PARTITION BY page_id ORDER BY y) AS part FROM s)
        SELECT page_id, min(y) AS y1, max(y) AS y2 FROM c WHERE ink >= 12 GROUP BY page_id, part HAVING max(y) - min(y) + 1 >= 3 AND max(ink) > 0""",
    "signal_peaks": """WITH RECURSIVE s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
        c AS (SELECT *, lag(v) OVER (ORDER BY pos) AS before FROM s), n AS (SELECT *, sum(CASE WHEN v = before THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS run FROM c),
        r AS (SELECT min(pos) AS a, max(pos) AS b, any_value(v) AS v FROM n GROUP BY run), e AS (SELECT *, lag(v) OVER (ORDER BY a) AS left_, lead(v) OVER (ORDER BY a) AS right_ FROM r),
        p AS MATERIALIZED (SELECT (a + b) // 2 AS pos, v, row_number() OVER (ORDER BY v DESC, a DESC) AS nth FROM e WHERE left_ < v AND right_ < v AND v >= 40),
        k AS (SELECT CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS kept UNION ALL
              SELECT p.nth, CASE WHEN len(list_filter(kept, lambda x: abs(x - p.pos) < 5)) = 0 THEN list_append(kept, p.pos) ELSE kept END FROM k JOIN p ON p.nth = k.nth + 1),
        t AS (SELECT unnest(kept) AS pos FROM (SELECT kept FROM k ORDER BY nth DESC LIMIT 1)), q AS (SELECT pos, v FROM p JOIN t USING (pos)),
        h AS (SELECT q.pos, q.v, max(s.pos) FILTER (s.pos < q.pos) AS l, min(s.pos) FILTER (s.pos > q.pos) AS r FROM q LEFT JOIN s ON s.v > q.v GROUP BY ALL),
        m AS (SELECT h.pos, h.v, greatest(min(s.v) FILTER (s.pos <= h.pos), min(s.v) FILTER (s.pos >= h.pos)) AS low FROM h JOIN s ON s.pos > coalesce(l, -1) AND s.pos < coalesce(r, 1e18) GROUP BY h.pos, h.v)
        SELECT CAST(pos AS BIGINT) AS pos, v AS value, round(v - low, 6) AS prominence FROM m WHERE v - low >= 20""",
    "absorbed_segments": """WITH s AS (SELECT user_id AS page_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS y, value AS ink FROM events),
        c AS (SELECT *, count(*) FILTER (ink < 12) OVER (PARTITION BY page_id ORDER BY y) AS part FROM s),
        g AS (SELECT page_id, min(y) AS a, max(y) AS b FROM c WHERE ink >= 12 GROUP BY page_id, part HAVING max(ink) > 0),
        w AS (SELECT *, min(a) OVER (PARTITION BY page_id) AS a0, count(*) OVER (PARTITION BY page_id) AS n FROM g),
        o AS (SELECT *, min(b) FILTER (b - a0 + 1 >= 3) OVER (PARTITION BY page_id) AS opened FROM w),
        h AS (SELECT *, greatest(1, count(*) FILTER (b = opened OR (b > opened AND b - a + 1 >= 3)) OVER (PARTITION BY page_id ORDER BY a)) AS g FROM o WHERE opened IS NOT NULL OR n = 1)
        SELECT page_id, min(a) AS y1, max(b) AS y2 FROM h GROUP BY page_id, g""",
    "component_periods": f"""WITH {LINES}, c AS (SELECT doc_id, length(line) AS area, length(unnest({toks('line')})) AS h FROM lines)
        SELECT doc_id, CAST(greatest(8, floor(quantile_cont(h, 0.75) * 1.5)) AS INTEGER) AS period FROM c WHERE area > 10 AND h > 3 AND h < 12.8 GROUP BY doc_id HAVING count(*) >= 3""",
    "sequential_cer": f"WITH {TURNS}, s AS (SELECT p.page_id, CAST(sum({lev('pred', 'gt')}) AS BIGINT) AS edits, CAST(sum(length(gt)) AS BIGINT) AS ref_len, count(*) AS lines FROM p JOIN g ON g.page_id = p.page_id AND gt_idx = pred_idx GROUP BY p.page_id) SELECT *, edits / greatest(ref_len, 1) AS cer FROM s",
    "best_match": f"""WITH t AS (SELECT item_id, {toks("text")} AS t FROM benchmark), i AS (SELECT item_id, t, unnest(range(0, len(t), 4)) AS i FROM t),
        g AS MATERIALIZED (SELECT item_id * 1000000 + CAST(i // 4 AS BIGINT) AS gt_idx, array_to_string(t[CAST(i + 1 AS BIGINT):CAST(i + 4 AS BIGINT)], ' ') AS gt FROM i),
        p AS (SELECT gt_idx AS own, substr({swap("gt")}, 2) AS pred FROM g), x AS (SELECT own, pred, gt_idx, gt, {lev("lower(pred)", "lower(gt)")} AS d FROM p, g),
        y AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY d, gt_idx) AS r FROM x)
        SELECT own, pred, gt_idx AS matched_idx, d AS distance, gt AS matched_gt, own <> gt_idx AS shifted FROM y WHERE r = 1""",
    "band_report": f"WITH {LINES}, r AS (SELECT lang, {lev('pred', 'line')} / greatest(length(line), 1) AS r FROM pairs) SELECT lang, CASE WHEN r <= 0.10 THEN 'good' WHEN r <= 0.20 THEN 'fair' ELSE 'poor' END AS band, CASE WHEN r <= 0.10 THEN 'good' WHEN r <= 0.15 THEN 'fair' ELSE 'poor' END AS trained, count(*) AS lines FROM r GROUP BY ALL",
    "folder_rollup": f"WITH {LINES}, d AS (SELECT doc_id, {lev('pred', 'line')} AS e, length(line) AS n FROM pairs), r AS (SELECT doc_id, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS ref_len, count(*) AS lines FROM d GROUP BY ROLLUP (doc_id)) SELECT *, edits / greatest(ref_len, 1) AS cer, printf('%.2f%%', round(edits / greatest(ref_len, 1), 4) * 100) AS shown FROM r",
    "page_documents": f"WITH {LINES} SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest, CAST(count(*) AS INTEGER) AS total_lines FROM lines GROUP BY doc_id",
    "surface_forms": f"WITH {LINES}, z AS (SELECT unnest({toks('line')}) AS corrected FROM lines) SELECT corrected, corrected || '.' AS original, count(*) AS n FROM z GROUP BY ALL",
    "training_pairs": """WITH """ + LINES + """, q AS (SELECT pred AS o, translate(pred, 'çÇ', 'zZ') AS r, line AS g FROM pairs),
        u AS (SELECT 'real' AS kind, o AS s, g FROM q WHERE o <> g UNION ALL SELECT 'rule', r, g FROM q WHERE r <> g UNION ALL SELECT 'identity', g, g FROM q)
        SELECT kind, count(*) AS pairs, CAST(sum(length('correct: ' || s)) AS BIGINT) AS source_chars, CAST(sum(length(g)) AS BIGINT) AS target_chars FROM u GROUP BY kind""",
    "noise_kinds": f"""WITH src AS MATERIALIZED (SELECT row_number() OVER () AS rid, conv_id, turn, text AS txt, concat_ws('|', '42', conv_id, turn) AS salt FROM conversations), {NOISE},
        a AS (SELECT 'words' AS kind, * FROM word_out UNION ALL SELECT 'type', * FROM old_out UNION ALL SELECT 'edits', * FROM edit_out)
        SELECT conv_id, turn, kind, noisy <> txt AS changed, CAST(length(noisy) AS INTEGER) AS chars, md5(noisy) AS digest FROM a JOIN src USING (rid)""",
    "synthetic_noise": f"WITH {COPIES.format('text')}, {NOISE}, {MIXED} SELECT conv_id, turn, CAST(copy AS INTEGER) AS copy, noisy <> txt AS changed, md5(noisy) AS digest FROM mixed",
    "augmented_pairs": f"""WITH {COPIES.format("trim(text)")}, {NOISE}, {MIXED},
        q AS (SELECT trim({swap("trim(text)")}) AS o, trim(translate({swap("trim(text)")}, 'çÇ', 'zZ')) AS r, trim(text) AS g FROM conversations),
        u AS (SELECT 'real' AS kind, o AS s, g FROM q WHERE o <> g UNION ALL SELECT 'rule', r, g FROM q WHERE r <> g UNION ALL SELECT 'identity', g, g FROM q UNION ALL SELECT 'synthetic', noisy, trim(txt) FROM mixed WHERE noisy <> trim(txt))
        SELECT kind, count(*) AS pairs, CAST(sum(length('correct: ' || s)) AS BIGINT) AS source_chars, CAST(sum(length(g)) AS BIGINT) AS target_chars FROM u WHERE s <> '' AND g <> '' GROUP BY kind""",
    "context_prev3": f"WITH c AS (SELECT conv_id, turn, {toks('text')} AS t FROM conversations), x AS (SELECT conv_id, turn, t, unnest(range(0, len(t))) AS i FROM c) SELECT conv_id, turn, CAST(i AS INTEGER) AS pos, t[i + 1] AS word, array_to_string(t[greatest(i - 2, 1):i], ' ') AS context FROM x",
    "context_pm5": f"WITH c AS (SELECT conv_id, turn, {toks('text')} AS t FROM conversations), x AS (SELECT conv_id, turn, t, unnest(range(0, len(t))) AS i FROM c) SELECT conv_id, turn, CAST(i AS INTEGER) AS pos, array_to_string(list_concat(list_concat(t[greatest(i - 4, 1):i], ['[' || t[i + 1] || ']']), t[i + 2:i + 6]), ' ') AS input FROM x",
    "moving_avg": "WITH s AS (SELECT user_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS y, value AS ink FROM events) SELECT page_id, CAST(y AS INTEGER) AS y, round(sum(ink) OVER (PARTITION BY page_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM s",
    "islands": """WITH s AS (SELECT user_id AS page_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS y, value AS ink FROM events),
        l AS (SELECT page_id, max(y) AS last FROM s GROUP BY page_id), h AS (SELECT page_id, y, CASE WHEN y - lag(y) OVER (PARTITION BY page_id ORDER BY y) <= 2 THEN 0 ELSE 1 END AS new FROM s WHERE ink >= 20),
        i AS (SELECT page_id, y, CAST(sum(new) OVER (PARTITION BY page_id ORDER BY y) AS BIGINT) AS island FROM h), f AS (SELECT page_id, island, min(y) AS start, max(y) AS stop FROM i GROUP BY ALL)
        SELECT page_id, island, start, CASE WHEN last - stop < 2 THEN last ELSE stop END AS stop FROM f JOIN l USING (page_id)""",
    "autocorr": """WITH s AS (SELECT user_id AS page_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y, value AS ink FROM events),
        m AS (SELECT page_id, avg(ink) AS m FROM s GROUP BY page_id HAVING count(*) >= 20 AND stddev_pop(ink) >= 1e-6), d AS (SELECT s.page_id, y, ink - m AS d FROM s JOIN m USING (page_id)),
        z AS (SELECT page_id, sum(d * d) AS z FROM d GROUP BY page_id), k AS (SELECT unnest(range(0, 13)) AS lag),
        a AS (SELECT d.page_id, lag, d.d * e.d AS x FROM d CROSS JOIN k LEFT JOIN d e ON e.page_id = d.page_id AND e.y = d.y + lag)
        SELECT a.page_id, CAST(lag AS INTEGER) AS lag, round(coalesce(sum(x), 0) / any_value(z), 6) AS acf FROM a JOIN z ON z.page_id = a.page_id GROUP BY a.page_id, lag""",
    "noise_area_filter": f"WITH {LINES}, a AS (SELECT doc_id, CAST(length(line) * length({toks('line')}[1]) AS DOUBLE) AS area FROM lines), m AS (SELECT doc_id, median(area) AS m FROM a GROUP BY doc_id) SELECT doc_id, count(*) AS kept, sum(area) AS area FROM a JOIN m USING (doc_id) WHERE area >= m * 0.20 GROUP BY doc_id",
    "changed_counts": f"WITH {LINES}, q AS (SELECT *, translate(pred, 'çÇ', 'zZ') AS rule FROM pairs) SELECT lang, count(*) AS lines, count(*) FILTER (pred <> line) AS ocr_changed, count(*) FILTER (rule <> line) AS rule_changed, count(*) FILTER (rule <> pred) AS rule_fixed FROM q GROUP BY lang",
    "html_escape": "WITH e AS (SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM pages) SELECT page_id, md5(e) AS digest, length(e) AS length FROM e",
    "word_punct": f"SELECT conv_id, turn, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+')) AS tokens, len({toks('text')}) AS words FROM conversations",
    "trailing_blank": "WITH t AS (SELECT doc_id AS page_id, string_split(text, chr(10)) AS t FROM documents), x AS (SELECT page_id, unnest(t) AS gt, generate_subscripts(t, 1) AS i FROM t), l AS (SELECT page_id, max(i) AS last FROM x WHERE trim(gt) <> '' GROUP BY page_id) SELECT page_id, count(*) AS lines, CAST(sum(length(gt)) AS BIGINT) AS chars FROM x JOIN l USING (page_id) WHERE i <= last GROUP BY page_id",
    "throughput_words": f"SELECT source, CAST(sum(len({toks('text')})) AS BIGINT) AS words, count(*) AS texts FROM documents GROUP BY source",
}
