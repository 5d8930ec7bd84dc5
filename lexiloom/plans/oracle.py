"""DuckDB SQL for the queries: windows, lists and unrolled levels instead of explodes and level-wise jobs."""

from __future__ import annotations

from lexiloom.functions.tails import HART, HART_BELOW
from lexiloom.functions.text import SENTENCE_END, TAG_RULES, TOKEN
from lexiloom.operators.candidates import COORDINATED, FILTERS, GROUP, coordination_pattern
from lexiloom.operators.ranking import BLACKLIST, LEAST_GLOSSEX
from lexiloom.operators.structure import COLLAPSERS, CONCEPT_COLLAPSERS
from lexiloom.plans.readers import BROKEN
from lexiloom.plans.queries import CONFIGURATIONS, KEYWORD, MIN_FREQ, RANKERS, SPAN, THRESHOLD

_TAG = "CASE " + " ".join(f"WHEN regexp_matches(word, '{p}') THEN '{t}'" for t, p in TAG_RULES) + " ELSE 'n' END"
_LEMMA = """CASE WHEN regexp_matches(word, '[^aeiou]ies$') AND length(word) > 4 THEN regexp_replace(word, 'ies$', 'y')
  WHEN regexp_matches(word, '(s|x|z|ch|sh)es$') AND length(word) > 4 THEN regexp_replace(word, 'es$', '')
  WHEN regexp_matches(word, '[^siu]s$') AND length(word) > 3 THEN regexp_replace(word, 's$', '') ELSE word END"""
_END = SENTENCE_END.replace("\\n", "\n")


def _tokens(name: str, source: str, key: str) -> str:
    """name(doc_id, sent_id, tok_idx, word, tag, lemma), and name_w with the next four lemmas and tags."""
    return f"""
{name}_p AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS sent_id, unnest(p) AS sent FROM (SELECT {key} AS doc_id, regexp_split_to_array(lower(text), '{_END}') AS p FROM {source})),
{name}_t AS (SELECT doc_id, sent_id, generate_subscripts(t, 1) - 1 AS tok_idx, unnest(t) AS word FROM (SELECT doc_id, sent_id, regexp_extract_all(sent, '{TOKEN}') AS t FROM {name}_p)),
{name} AS (SELECT *, {_TAG} AS tag, {_LEMMA} AS lemma FROM {name}_t),
{name}_w AS (SELECT doc_id, sent_id, tok_idx, lemma AS l1, tag AS t1, {", ".join(f"lead(lemma, {i - 1}) OVER w AS l{i}, lead(tag, {i - 1}) OVER w AS t{i}" for i in range(2, 6))}
  FROM {name} WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_idx))"""


def _runs(name: str, words: str, least: int, most: int) -> str:
    """name(doc_id, sent_id, tok_idx, n, term, tags): all runs of least to most tokens."""
    parts = [
        f"SELECT doc_id, sent_id, tok_idx, {n} AS n, {" || ' ' || ".join(f'l{i}' for i in range(1, n + 1))} AS term, {' || '.join(f't{i}' for i in range(1, n + 1))} AS tags FROM {words} WHERE l{n} IS NOT NULL"
        for n in range(least, most + 1)
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


TARGET = _tokens("tok", "(SELECT * FROM documents WHERE lang = 'en')", "doc_id")
REFERENCE = _tokens("rtok", "conversations", "conv_id || '-' || turn")
BENCH = _tokens("btok", "benchmark", "item_id")
LIST = f"{BENCH}, {_runs('bruns', 'btok_w', 2, 5)}, lst AS (SELECT DISTINCT term FROM bruns)"


def _model(most: int, least_freq: int = MIN_FREQ, name: str = "model", runs: str = "runs", words: str = "tok_w") -> str:
    return f"{_runs(runs, words, 1, most)}, {name} AS MATERIALIZED (SELECT term, n, count(*) AS freq FROM {runs} GROUP BY term, n HAVING count(*) >= {least_freq})"


def _found(tag_filter: str = "simple", least: int = 2, name: str = "found", runs: str = "cruns") -> str:
    return f"{_runs(runs, 'tok_w', least, 5)}, {name} AS MATERIALIZED (SELECT * FROM {runs} WHERE regexp_full_match(tags, '{FILTERS[tag_filter]}'))"


TYPES = "types AS MATERIALIZED (SELECT term, n, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM found GROUP BY term, n)"
CANDIDATES = f"{_found()}, {TYPES}"
N = "(SELECT coalesce(sum(freq), 0) FROM model WHERE n = 1)"
RN = "(SELECT coalesce(sum(freq), 0) FROM rmodel WHERE n = 1)"


def _levels(choices: bool = False) -> str:
    """nested(term, n, freq, rect_freq, c_value), one level for each length from five to two; who holds whom is listed once."""
    parts = (
        "SELECT DISTINCT term AS super, array_to_string(list_transform(list_filter(range(1, 6), lambda i: i <= n AND (mask >> (i - 1)) & 1 = 1), lambda i: l[i]), ' ') AS sub FROM (SELECT term, n, string_split(term, ' ') AS l, unnest(range(1, (1 << n) - 1)) AS mask FROM types)"
        if choices
        else "SELECT DISTINCT term AS super, array_to_string(list_slice(l, i, i + k - 1), ' ') AS sub FROM (SELECT term, n, string_split(term, ' ') AS l, unnest(range(1, 5)) AS i FROM types), range(2, 5) z(k) WHERE k < n AND i + k - 1 <= n"
    )
    out = [f"edges AS MATERIALIZED (SELECT super, sub, t.n FROM ({parts}) JOIN types t ON t.term = sub)"]
    for n in range(5, 1, -1):
        longer = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(5, n, -1))
        sums = f"""SELECT sub, sum(rf) AS nested, sum(own) FILTER (taken) AS nt, avg(own) FILTER (taken AND own > 0) AS mt, bool_or(taken) AS taken FROM edges JOIN ({longer}) x ON x.term = super WHERE edges.n = {n} GROUP BY sub"""
        out.append(f"s{n} AS ({sums if longer else "SELECT '' AS sub, 0 AS nested, 0 AS nt, 0.0 AS mt, false AS taken WHERE false"})")
        c = f"log2({n}) * CASE WHEN coalesce(s.taken, false) THEN t.freq - coalesce(mt, 0.0) ELSE t.freq END"
        out.append(f"v{n} AS MATERIALIZED (SELECT t.term, t.n, t.freq, t.freq - coalesce(nested, 0) AS rf, t.freq - coalesce(nt, 0) AS own, {c} AS c, {c} >= {THRESHOLD} AS taken FROM types t LEFT JOIN s{n} s ON t.term = s.sub WHERE t.n = {n})")
    union = " UNION ALL ".join(f"SELECT term, n, freq, rf::BIGINT AS rect_freq, c AS c_value FROM v{n}" for n in range(5, 1, -1))
    return ", ".join([*out, f"nested AS ({union})"])


def _sums(terms: str, with_reference: bool) -> str:
    weird = f", avg(ln((coalesce(m.freq, 0) + 1.0) * ({RN} + 1) / ((coalesce(r.freq, 0) + 1.0) * ({N} + 1)))) AS glossex" if with_reference else ""
    join = "LEFT JOIN rmodel r ON r.n = 1 AND r.term = w.word" if with_reference else ""
    return f"""sums AS (SELECT w.term, sum(coalesce(m.freq, 0)) AS words_freq, sum(ln((coalesce(m.freq, 0) + 1.0) / ({N} + 1))) AS word_logs{weird}
  FROM (SELECT term, unnest(string_split(term, ' ')) AS word FROM {terms}) w LEFT JOIN model m ON m.n = 1 AND m.term = w.word {join} GROUP BY w.term)"""


RMODEL = f"{REFERENCE}, {_model(1, 1, 'rmodel', 'rruns', 'rtok_w')}"
METRICS = f"""{TARGET}, {RMODEL}, {_model(5)}, {CANDIDATES}, {_levels()}, {_sums('types', True)},
metrics AS MATERIALIZED (SELECT o.term, o.n::INTEGER AS n, o.freq, o.docs, round(v.c_value, 6) AS c_value, v.rect_freq,
  round(o.freq * (SELECT count(DISTINCT doc_id) FROM found) / (o.docs + 1)::DOUBLE, 6) AS tf_idf, round(s.glossex, 6) AS glossex,
  round((ln((coalesce(m.freq, 0) + 1.0) / ({N} + 1)) - s.word_logs) / (o.n - 1), 6) AS pmi_nl,
  round(CASE WHEN coalesce(m.freq, 0) = 0 THEN 0.0 ELSE log10(m.freq) * o.n * m.freq / s.words_freq END, 6) AS term_coherence
  FROM types o JOIN nested v USING (term) JOIN sums s USING (term) LEFT JOIN model m ON m.term = o.term)"""
VOTED = f"""{METRICS}, ranks AS (SELECT *, {", ".join(f"row_number() OVER (ORDER BY {r} DESC NULLS LAST, term)::INTEGER AS rank_{r}" for r in RANKERS)} FROM metrics),
voted AS (SELECT *, round({" + ".join(f"1.0::DOUBLE / rank_{r}" for r in RANKERS)}, 9) AS vote FROM ranks)"""
_PREDICATES = [f"c_value >= {THRESHOLD}", f"rect_freq >= {MIN_FREQ}", f"glossex >= {LEAST_GLOSSEX}", f"NOT list_has_any(string_split(term, ' '), [{', '.join(repr(w) for w in BLACKLIST)}])"]
_HELD = " + ".join(f"({p})::INT" for p in _PREDICATES)
GOLD = "gold AS (SELECT * FROM found WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"
PREDICTED = f"predicted AS (SELECT term FROM nested WHERE c_value >= {THRESHOLD} AND freq >= {MIN_FREQ})"


def _pr(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p, r = f"coalesce({tp} / nullif({tp} + {fp}, 0)::DOUBLE, 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0)::DOUBLE, 0)"
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 6) AS f1"


UNITHOOD = f"""{TARGET}, {_model(2)}, cells0 AS (SELECT t.term, t.freq, a.freq AS freq_a, b.freq AS freq_b, {N} AS n1, t.freq + 1.0::DOUBLE AS ab
    FROM model t JOIN model a ON a.n = 1 AND a.term = split_part(t.term, ' ', 1) JOIN model b ON b.n = 1 AND b.term = split_part(t.term, ' ', 2) WHERE t.n = 2),
cells1 AS (SELECT *, CASE WHEN freq_a - ab + 2 <= 0 THEN 1 ELSE freq_a - ab + 2 END AS a_nb, CASE WHEN freq_b - ab + 2 <= 0 THEN 1 ELSE freq_b - ab + 2 END AS na_b FROM cells0),
cells2 AS (SELECT *, n1 - a_nb - na_b - ab + 4 AS na_nb FROM cells1),
cells AS (SELECT *, ab + a_nb AS r1, na_b + na_nb AS r2, ab + na_b AS c1, a_nb + na_nb AS c2, ab + a_nb + na_b + na_nb AS nn FROM cells2),
uni AS (SELECT *, 2 * (ab * ln(ab / r1) + a_nb * ln(1 - ab / r1) + na_b * ln(na_b / r2) + na_nb * ln(1 - na_b / r2)
    - ab * ln(c1 / nn) - a_nb * ln(1 - c1 / nn) - na_b * ln(c1 / nn) - na_nb * ln(1 - c1 / nn)) AS llr,
  ab / nn * ln(ab * nn / (r1 * c1)) + a_nb / nn * ln(a_nb * nn / (r1 * c2)) + na_b / nn * ln(na_b * nn / (r2 * c1)) + na_nb / nn * ln(na_nb * nn / (r2 * c2)) AS mi,
  ln(ab * nn / (r1 * c1)) AS pmi, ln((freq + 1.0) * (n1 + 1) / ((freq_a + 1.0) * (freq_b + 1))) AS ngram_pmi,
  2.0 * freq / (freq_a + freq_b) AS dice, log10(freq) * 2.0 * freq / (freq_a + freq_b) AS term_coherence FROM cells)"""


def _uni(*columns: str) -> str:
    return f"WITH {UNITHOOD} SELECT term, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM uni"


def _span_pieces(where: str) -> str:
    return f"""pieces AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS word FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}|[^\\p{{L}}\\p{{N}},]+') AS p FROM documents WHERE lang = 'en' {where})),
placed AS (SELECT *, (sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM pieces), spans AS (SELECT doc_id, e - length(word) AS start, e AS "end", word FROM placed WHERE regexp_matches(word, '^[\\p{{L}}\\p{{N}},]'))"""


SENT = "sent AS MATERIALIZED (SELECT doc_id, sent_id, list(lemma ORDER BY tok_idx) AS l, list(word ORDER BY tok_idx) AS w, string_agg(tag, '' ORDER BY tok_idx) AS t FROM tok GROUP BY doc_id, sent_id)"


def _strong(name: str, pairs: str) -> str:
    """name(a, b, freq, strength): the lemma pairs that are strong enough as bridges."""
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT a, b, t.freq, ln((t.freq + 1.0) * ({N} + 1) / ((coalesce(x.freq, 0) + 1.0) * (coalesce(y.freq, 0) + 1))) + log10(t.freq) AS strength
  FROM (SELECT DISTINCT a, b FROM {pairs}) JOIN model t ON t.n = 2 AND t.term = a || ' ' || b LEFT JOIN model x ON x.n = 1 AND x.term = a LEFT JOIN model y ON y.n = 1 AND y.term = b) WHERE strength > 1 AND freq >= 1)"""


def _legal(at: str) -> str:
    """Whether the places of a way have a gap, and none whose words repeat the run before or after it; l: the sentence's lemmas."""
    run = lambda k, side: f"list_transform(list_filter({at}, lambda x, q: q {side} AND x - q = {at}[{k}] - ({k})), lambda x: l[x + 1])"
    gap = f"l[{at}[k] + 2 : {at}[k + 1]]"
    wide = f"{at}[k + 1] - {at}[k] > 1"
    steps = f"range(1, len({at}))"
    return f"len(list_filter({steps}, lambda k: {wide})) > 0 AND len(list_filter({steps}, lambda k: {wide} AND (list_has_all({gap}, {run('k', '<= k')}) OR list_has_all({gap}, {run('k + 1', '> k')})))) = 0"


def _placed(name: str, source: str, text: str, pattern: str, kept: str, bounded: bool) -> str:
    """name(kept, m, at): the matches of a pattern with their places, as sums of what lies before; bounded: in texts of a hundred letters at most."""
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda v: length(v))), 0)"
    return f"""{name} AS (SELECT {kept}, h[k] AS m, ({size("g[1 : k]")} + {size("h[1 : k - 1]")})::INTEGER AS st
  FROM (SELECT *, regexp_extract_all({text}, '{pattern}') AS h, string_split_regex({text}, '{pattern}') AS g FROM {source}), {"range(1, 101)" if bounded else "LATERAL (SELECT unnest(range(1, len(h) + 1)))"} z(k) WHERE k <= len(h))"""


_CO, _CONCEPT = COORDINATED["simple"]
_PATTERN = coordination_pattern(_CO)


def _coord(bounded: bool) -> str:
    """coord(doc_id, sent_id, pos, term, tags): ways over bridges through coordinations, by recursion from each start.

    bounded: through those of 14 tokens at most in sentences of a hundred at most.
    """
    long_, longer = ("len(l) <= 100 AND ", " WHERE length(m) <= 14") if bounded else ("", "")
    starts, stops = ("range(0, 11) x(s)", "range(4, 15) y(e)") if bounded else ("LATERAL (SELECT unnest(range(0, n - 3))) x(s)", "LATERAL (SELECT unnest(range(s + 4, n + 1))) y(e)")
    steps = "range(0, 14) x(i)" if bounded else "LATERAL (SELECT unnest(range(s, e - 1))) x(i)"
    return f"""{SENT},
{_placed("cm", f"(SELECT * FROM sent WHERE {long_}contains(t, 'c'))", "t", _PATTERN, "doc_id, sent_id, l, w", bounded)},
co AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, sent_id, l, st AS first, m AS tags, length(m) AS n, l[st + 1 : st + length(m)] AS lem, w[st + 1 : st + length(m)] AS wd FROM cm{longer}),
{_placed("gm", "co", "tags", GROUP, "id, tags, n, lem, wd", bounded)},
gp AS (SELECT id, st AS a, st + length(m) - 1 AS z, substring(tags, st + 1, 1) = 'n' AND wd[st + 1] <> lem[st + 1] AS plural,
  list_filter(range(st + 1, st + length(m) - 2 - CASE WHEN length(m) > 3 AND substring(m, length(m) - 2, 1) = ',' THEN 1 ELSE 0 END), lambda i: substring(tags, i + 1, 1) <> ',') AS listed,
  n, instr(substring(tags, st + length(m) + 1), 'c') AS nx, instr(reverse(substring(tags, 1, st)), 'c') AS bk FROM gm),
gr AS (SELECT id, a, z, plural, listed, CASE WHEN nx = 0 THEN range(z + 1, n) ELSE list_append(range(z + 1, z + nx), z + nx + 1) END AS behind, CASE WHEN bk = 0 THEN range(0, a) ELSE list_append(range(a - bk + 1, a), a - bk - 1) END AS ahead FROM gp),
pr AS MATERIALIZED (SELECT DISTINCT id, i, j FROM (SELECT id, a AS i, unnest(behind) AS j FROM gr WHERE NOT plural UNION ALL SELECT id, i, unnest(list_append(listed, z)) FROM (SELECT *, unnest(ahead) AS i FROM gr)
  UNION ALL SELECT id, i, unnest(behind) FROM (SELECT *, unnest(listed) AS i FROM gr))),
cpairs AS (SELECT lem[i + 1] AS a, lem[j + 1] AS b FROM pr JOIN co USING (id)),
{_strong("ck", "cpairs")},
cb AS MATERIALIZED (SELECT id, i, j FROM pr JOIN co USING (id) JOIN ck ON lem[i + 1] = a AND lem[j + 1] = b),
se AS MATERIALIZED (SELECT co.*, s, e FROM co, {starts}, {stops} WHERE id IN (SELECT id FROM cb) AND e >= s + 4 AND e <= n AND regexp_full_match(substring(tags, s + 1, e - s), '{_PATTERN}')),
nx AS MATERIALIZED (SELECT id, s, e, i, j FROM se JOIN cb USING (id) UNION SELECT id, s, e, i, i + 1 FROM se, {steps} WHERE i >= s AND i + 1 < e AND substring(tags, i + 2, 1) NOT IN ('c', ',')),
cway(id, s, e, way) AS (SELECT id, s, e, [s] FROM se UNION ALL SELECT w.id, w.s, w.e, list_append(way, j) FROM cway w JOIN nx ON nx.id = w.id AND nx.s = w.s AND nx.e = w.e AND nx.i = way[-1]),
cdone AS (SELECT doc_id, sent_id, l, list_transform(way, lambda i: i + first) AS pos, array_to_string(list_transform(way, lambda i: lem[i + 1]), ' ') AS term, array_to_string(list_transform(way, lambda i: substring(tags, i + 1, 1)), '') AS wtags
  FROM cway JOIN se USING (id, s, e) WHERE way[-1] + 1 >= e OR substring(tags, way[-1] + 2, 1) IN ('c', ',')),
coord AS MATERIALIZED (SELECT DISTINCT doc_id, sent_id, pos, term, wtags AS tags FROM cdone WHERE regexp_full_match(wtags, '{_CONCEPT}') AND {_legal("pos")})"""


COORD, COORD_ALL = _coord(True), _coord(False)
#: hyper(doc_id, sent_id, pos, term, tags): ways over bridges through contiguous and coordinated candidates.
HYPER = f"""{COORD_ALL},
hc AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT doc_id, sent_id, pos, string_split(term, ' ') AS lem, tags FROM
  (SELECT doc_id, sent_id, range(tok_idx, tok_idx + n) AS pos, term, tags FROM found UNION ALL SELECT * FROM coord)) WHERE len(lem) >= 3),
hp AS MATERIALIZED (SELECT id, i, j, lem[i + 1] AS a, lem[j + 1] AS b FROM (SELECT *, unnest(range(i + 2, len(lem))) AS j FROM (SELECT *, unnest(range(0, len(lem) - 2)) AS i FROM hc))),
{_strong("hk", "hp")},
hb AS MATERIALIZED (SELECT id, i, j FROM hp JOIN hk USING (a, b)),
hs AS MATERIALIZED (SELECT * FROM hc WHERE id IN (SELECT id FROM hb)),
hn AS MATERIALIZED (SELECT * FROM hb UNION SELECT id, i, i + 1 FROM hs, LATERAL (SELECT unnest(range(0, len(lem)))) x(i) WHERE i + 1 < len(lem) AND substring(tags, i + 2, 1) NOT IN ('c', ',')),
hway(id, way) AS (SELECT id, [0::BIGINT] FROM hs UNION ALL SELECT w.id, list_append(way, j) FROM hway w JOIN hn ON hn.id = w.id AND hn.i = way[-1]),
hdone AS MATERIALIZED (SELECT DISTINCT doc_id, sent_id, list_transform(way, lambda i: pos[i + 1]) AS pos, array_to_string(list_transform(way, lambda i: lem[i + 1]), ' ') AS term, array_to_string(list_transform(way, lambda i: substring(tags, i + 1, 1)), '') AS wtags
  FROM hway JOIN hs USING (id) WHERE way[-1] + 1 >= len(lem) OR substring(tags, way[-1] + 2, 1) IN ('c', ',')),
hgap AS MATERIALIZED (SELECT * FROM hdone WHERE regexp_matches(wtags, '^(?:{FILTERS["simple"]})') AND pos[-1] - pos[1] >= len(pos)),
hctx AS MATERIALIZED (SELECT hgap.*, l[pos[1] + 1 : pos[-1] + 1] AS l, list_transform(pos, lambda i: i - pos[1]) AS rel FROM hgap JOIN sent USING (doc_id, sent_id)),
hyper AS MATERIALIZED (SELECT doc_id, sent_id, pos, term, wtags AS tags FROM hctx WHERE {_legal("rel")})"""


def _as_disc(source: str, more: str = "") -> str:
    return f"SELECT doc_id, sent_id::INTEGER AS sent_id, array_to_string(pos, ' ') AS positions, term, tags{more} FROM {source}"


#: win(doc_id, a, b): places around the keyword.
_WINDOWS = f"win AS (SELECT doc_id, greatest(0, start - 20) AS a, \"end\" + 20 AS b FROM spans WHERE word = '{KEYWORD}')"


def _between(name: str, separator: str) -> str:
    """name(doc_id, i, a, b): pieces between separators, i from 1, without empty ones."""
    return f"""{name}_p AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS t, x FROM (SELECT doc_id, string_split_regex(text, '{separator}') AS p, regexp_extract_all(text, '{separator}') AS x FROM documents WHERE lang = 'en')),
{name}_s AS (SELECT doc_id, i, length(t) AS n, (sum(length(t) + coalesce(length(x[i]), 0)) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - coalesce(length(x[i]), 0))::BIGINT AS a FROM {name}_p),
{name} AS (SELECT doc_id, i, a, a + n AS b FROM {name}_s WHERE n > 0)"""


_SKIP = [("l1 || ' {*} ' || l3", 2, 3), ("l1 || ' {*} ' || l3 || ' ' || l4", 3, 4), ("l1 || ' ' || l2 || ' {*} ' || l4", 3, 4), ("l1 || ' {*} {*} ' || l4", 2, 4)]
SKIPGRAMS = "skips AS (SELECT pattern, n_words, count(*) AS freq FROM (" + " UNION ALL ".join(f"SELECT {p} AS pattern, {k}::INTEGER AS n_words FROM tok_w WHERE l{n} IS NOT NULL" for p, k, n in _SKIP) + ") GROUP BY ALL HAVING count(*) >= 5)"
_LABELLED = "lab AS (SELECT n_chars::DOUBLE AS v, quality = 1 AS flag, lang FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"
_Q = [("q0", 0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q100", 1)]

def _side(prefix: str, where: str, types: bool = False) -> str:
    """The five figures of a part of the results table."""
    p, g = ("final", "is_gold") if types else ("taken AND is_cand", "is_gold")
    tp, fp, fn = f"count(*) FILTER ({where} AND {p} AND {g})", f"count(*) FILTER ({where} AND {p} AND NOT {g})", f"count(*) FILTER ({where} AND NOT ({p}) AND {g})"
    ok = f"count(*) FILTER ({where} AND {p} AND NOT {g} AND fp_ok)"
    lost = f"count(*) FILTER ({where} AND NOT ({p}) AND {g} AND fn_ok)"
    ratio = lambda a, b, n: f"round(coalesce(({a}) / nullif({b}, 0)::DOUBLE, 0), 6) AS {prefix}_{n}"
    return ", ".join([ratio(tp, f"{tp} + {fp}", "prec"), ratio(f"{tp} + {ok}", f"{tp} + {fp}", "corr_prec"), ratio(tp, f"{tp} + {fn}", "recall"), ratio(tp, f"{tp} + {fn} - {lost}", "corr_recall"), f"({tp} + {fp})::BIGINT AS {prefix}_n_concepts"])


RESULTS = f"""WITH RECURSIVE {METRICS}, {LIST}, {COORD_ALL}, {_found("liberal", 2, "wide", "wruns")},
conf(freq_threshold, c_value_threshold, glossex_threshold) AS (SELECT a::INTEGER, b::DOUBLE, c::DOUBLE FROM (VALUES {", ".join(str(c) for c in CONFIGURATIONS)}) v(a, b, c)),
lab AS (SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
inst AS (SELECT doc_id, sent_id, range(tok_idx, tok_idx + n) AS pos, term, tags, false AS d FROM found SEMI JOIN lab USING (doc_id) UNION SELECT doc_id, sent_id, pos, term, tags, true FROM coord SEMI JOIN lab USING (doc_id)),
gld AS (SELECT doc_id, sent_id, range(tok_idx, tok_idx + n) AS pos, term, tags, false AS d FROM wide SEMI JOIN good USING (doc_id) UNION SELECT doc_id, sent_id, pos, term, tags, true FROM coord SEMI JOIN good USING (doc_id)),
gcount AS MATERIALIZED (SELECT term, count(*) AS gf FROM gld GROUP BY term),
both_ AS MATERIALIZED (SELECT coalesce(i.term, g.term) AS term, coalesce(i.tags, g.tags) AS tags, coalesce(i.d, g.d) AS d, i.doc_id IS NOT NULL AS is_cand, g.doc_id IS NOT NULL AS is_gold
  FROM inst i FULL JOIN gld g ON i.doc_id = g.doc_id AND i.sent_id = g.sent_id AND i.pos = g.pos AND i.d = g.d AND i.term = g.term),
fin AS (SELECT conf.*, term FROM metrics, conf WHERE c_value >= c_value_threshold AND rect_freq >= freq_threshold AND glossex >= glossex_threshold AND {_PREDICATES[3]}),
flags AS (SELECT conf.*, b.d, is_cand, is_gold, f.term IS NOT NULL OR b.term IN (SELECT term FROM lst) AS taken, gf IS NOT NULL OR b.term IN (SELECT term FROM lst) AS fp_ok,
  len(string_split(b.term, ' ')) > 5 OR NOT regexp_matches(b.tags, '^(?:.+n)') OR coalesce(gf, 0) BETWEEN 1 AND conf.freq_threshold - 1 AS fn_ok
  FROM both_ b CROSS JOIN conf LEFT JOIN fin f ON f.term = b.term AND (f.freq_threshold, f.c_value_threshold, f.glossex_threshold) = (conf.freq_threshold, conf.c_value_threshold, conf.glossex_threshold) LEFT JOIN gcount ON gcount.term = b.term),
every AS (SELECT term FROM metrics UNION SELECT term FROM gcount),
tflags AS (SELECT conf.*, f.term IS NOT NULL AS final, gf IS NOT NULL AS is_gold, e.term IN (SELECT term FROM lst) AS fp_ok, len(string_split(e.term, ' ')) > 5 OR coalesce(gf, 0) BETWEEN 1 AND conf.freq_threshold - 1 AS fn_ok
  FROM every e CROSS JOIN conf LEFT JOIN fin f ON f.term = e.term AND (f.freq_threshold, f.c_value_threshold, f.glossex_threshold) = (conf.freq_threshold, conf.c_value_threshold, conf.glossex_threshold) LEFT JOIN gcount ON gcount.term = e.term),
one AS (SELECT freq_threshold, c_value_threshold, glossex_threshold, {_side("all", "true")}, {_side("dc", "d")} FROM flags GROUP BY ALL),
two AS (SELECT freq_threshold, c_value_threshold, glossex_threshold, {_side("types", "true", True)} FROM tflags GROUP BY ALL)
SELECT * FROM one JOIN two USING (freq_threshold, c_value_threshold, glossex_threshold)"""

#: put(id, sent_id, word, tag, a, b, o): tokens with their places, words parted by one sign; o, whether a token precedes. With glue commas lose that sign.
def _put(glue: bool) -> str:
    own = "(tag = ',' AND k > 1)::INT" if glue else "0"
    return f"""put0 AS (SELECT doc_id::VARCHAR AS id, doc_id, sent_id, tok_idx, word, tag, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, tok_idx) AS k FROM tok),
put AS (SELECT *, a0 + length(word) AS b, a0 AS a FROM (SELECT *, sum(length(word) + 1 - {own}) OVER (PARTITION BY id ORDER BY k) - length(word) - 1 AS a0, {own} AS g FROM put0))"""


def _rows(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def _row(kind: str, start: str = "a", end: str = "b", pos: str = "NULL", rest: str = "") -> str:
    return f"SELECT id AS doc_id, '{kind}' AS kind, ({start})::INTEGER AS start, ({end})::INTEGER AS \"end\", {pos} AS pos FROM put {rest}"


_SENTENCES = _row("sentence", "min(a)", "max(b)", rest="GROUP BY id, sent_id")
_WHOLE = f"id::BIGINT % {BROKEN} <> 0"
_LEMMAS = " || ' ' || ".join(f"(SELECT {_LEMMA} FROM (SELECT lower(w[{i}]) AS word))" for i in (1, 2))

_SUPER = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{p}'" for p in COLLAPSERS) + " ELSE s END"


def _simpson(low: str, high: str, f: str, n: int = 20_000) -> str:
    """The integral of f(x) by Simpson's rule."""
    return f"(SELECT sum(({f}) * CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * any_value(h) / 3 FROM (SELECT i, h, lo + i * h AS x FROM (SELECT {low} AS lo, (({high}) - ({low})) / {n} AS h), range(0, {n} + 1) r(i)))"


def _beta(a: str, b: str, x: str) -> str:
    """The incomplete beta function as an integral of powers of sine and cosine."""
    return f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * 2 * {_simpson('0.0', f'asin(sqrt({x}))', f'pow(sin(x), 2 * ({a}) - 1) * pow(cos(x), 2 * ({b}) - 1)')}"


def _kind(one: str, other: str, term: str = "term") -> str:
    c, d = (f"{term} IN (SELECT term FROM {x})" for x in (one, other))
    return f"CASE WHEN {c} AND {d} THEN 'both' WHEN {c} THEN 'only_CC' WHEN {d} THEN 'only_DC' ELSE 'neither' END AS kind"


ORACLE = {
    "matchers": f"WITH {TARGET}, {LIST}, {CANDIDATES}, {GOLD} SELECT term, freq, term IN (SELECT term FROM lst) AS in_list, term IN (SELECT term FROM gold) AS in_gold, term IN (SELECT term FROM found WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS in_bad FROM types",
    "bigram_sides": f"""WITH RECURSIVE {TARGET}, {_model(2)}, {CANDIDATES}, {COORD_ALL}, c AS (SELECT DISTINCT list_extract(l, i) || ' ' || list_extract(l, i + 1) AS term FROM (SELECT string_split(term, ' ') AS l FROM types), range(1, 5) x(i) WHERE i < len(l)),
dd AS (SELECT DISTINCT l[i] || ' ' || l[i + 1] AS term FROM (SELECT string_split(term, ' ') AS l FROM coord), LATERAL (SELECT unnest(range(1, len(l)))) x(i))
SELECT term, round(log10(freq), 6) AS log_freq, {_kind("c", "dd")} FROM model WHERE n = 2""",
    "concept_sides": f"""WITH RECURSIVE {TARGET}, {_model(5)}, {CANDIDATES}, {COORD_ALL}, both_ AS (SELECT term FROM types UNION SELECT term FROM coord), {_sums("both_", False)}
SELECT b.term, coalesce(m.freq, 0) AS freq, {_kind("types", "coord", "b.term")}, round((ln((coalesce(m.freq, 0) + 1.0) / ({N} + 1)) - s.word_logs) / (len(string_split(b.term, ' ')) - 1), 6) AS pmi_nl FROM both_ b JOIN sums s ON s.term = b.term LEFT JOIN model m ON m.term = b.term""",
    "structure_counts": f"""WITH RECURSIVE {TARGET}, {_model(2)}, {COORD}, f AS (SELECT c.tags AS own, t[pos[1] + 1 : pos[-1] + 1] AS s, array_to_string(list_transform(range(pos[1], pos[-1] + 1), lambda i: CASE WHEN list_contains(pos, i) THEN t[i + 1] ELSE '#' END), '') AS skip,
  array_to_string(w[pos[1] + 1 : pos[-1] + 1], ' ') AS text FROM coord c JOIN sent USING (doc_id, sent_id) WHERE len(pos) < 10),
g AS (SELECT CASE WHEN regexp_full_match(own, '{CONCEPT_COLLAPSERS[0]}') THEN '{CONCEPT_COLLAPSERS[0]}' ELSE own END AS concept, {_SUPER} AS super, skip, text FROM f WHERE contains(s, 'c'))
SELECT concept, super, skip, count(*) AS n, min(text) AS example, round(100 * count(*) / (SELECT count(*) FROM g)::DOUBLE, 2) AS percent FROM g GROUP BY concept, super, skip""",
    "reader_slashed": f"WITH {TARGET}, {_put(False)} {_rows(_SENTENCES, _row('token', pos='upper(tag)'))}",
    "reader_inline": f"WITH {TARGET}, {_put(False)} {_rows(_row('sentence', 'min(a)', 'max(b)', rest=f'WHERE {_WHOLE} GROUP BY id, sent_id'), _row('token', pos='tag', rest=f'WHERE {_WHOLE}'), _row('concept', rest=f'WHERE tag = {chr(39)}n{chr(39)} AND {_WHOLE}'))} UNION ALL SELECT DISTINCT id, 'bad', NULL::INTEGER, NULL::INTEGER, 'ParseError' FROM put WHERE NOT ({_WHOLE})",
    "reader_vertical": f"WITH {TARGET}, {_put(True)} {_rows(_row('sentence', 'min(a + g)', 'max(b)', rest='GROUP BY id, sent_id'), _row('token', pos='tag'), _row('concept', rest=f'WHERE tag = {chr(39)}n{chr(39)}'))}",
    "reader_annotations": f"WITH {_span_pieces('')} SELECT doc_id::VARCHAR AS doc_id, 'Token' AS kind, start::INTEGER AS start, \"end\"::INTEGER AS \"end\", {_TAG} AS pos FROM (SELECT doc_id, start, \"end\", lower(word) AS word FROM spans)",
    "reader_blocks": "SELECT doc_id || '_1' AS doc_id, length(t)::BIGINT AS n, md5(t) AS md5 FROM (SELECT doc_id, '<doc id=\"' || doc_id || '\">' || chr(10) || translate(coalesce(text, ''), '<>', '()') || chr(10) || '</doc>' AS t FROM documents)",
    "reader_terms": f"""WITH b AS (SELECT * FROM (SELECT item_id, list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 6),
r AS (SELECT item_id, 3 AS line, lower(w[1] || ' ' || w[2]) AS term, lower(w[1] || ' ' || w[2]) AS main FROM b UNION ALL SELECT item_id, 3, {_LEMMAS}, lower(w[1] || ' ' || w[2]) FROM b
  UNION ALL SELECT item_id, 4, lower(w[3] || ' ' || w[4]), lower(w[1] || ' ' || w[2]) FROM b UNION ALL SELECT item_id, 6, lower(w[5]), lower(w[1] || ' ' || w[2]) FROM b)
SELECT term, arg_max(main, (item_id, line)) AS main FROM r GROUP BY term""",
    "corpus_source": f"""WITH {TARGET}, c AS (SELECT doc_id, sum(length(word) + 1)::BIGINT - 1 AS n, count(*)::INTEGER AS tokens, count(DISTINCT sent_id) AS lines FROM tok GROUP BY doc_id)
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % {BROKEN} <> 0 THEN n END AS n, CASE WHEN doc_id % {BROKEN} <> 0 THEN tokens END AS tokens, CASE WHEN doc_id % {BROKEN} = 0 THEN 'ValueError: line ' || lines || ' holds ''untagged'', which is no word/tag' END AS reason FROM c""",
    "results_table": RESULTS,
    "sentences": f"WITH {TARGET} SELECT doc_id, sent_id::INTEGER AS sent_id, string_agg(word, ' ' ORDER BY tok_idx) AS words, string_agg(tag, '' ORDER BY tok_idx) AS tags, string_agg(lemma, ' ' ORDER BY tok_idx) AS lemmas FROM tok GROUP BY doc_id, sent_id",
    "tokens": f"WITH {TARGET} SELECT doc_id, sent_id::INTEGER AS sent_id, tok_idx::INTEGER AS tok_idx, word, tag, lemma FROM tok",
    "pos_dist": f"WITH {TARGET} SELECT tag, count(*) AS n, min(word) AS example, round(100 * count(*) / (SELECT count(*) FROM tok)::DOUBLE, 2) AS percent FROM tok GROUP BY tag",
    "corpus_stats": f"WITH {TARGET}, {_found(least=1)} SELECT (SELECT count(DISTINCT doc_id) FROM tok) AS docs, (SELECT count(*) FROM (SELECT DISTINCT doc_id, sent_id FROM tok)) AS sentences, (SELECT count(*) FROM tok) AS tokens, count(*) AS concepts, count(DISTINCT term) AS concepts_types, 0::BIGINT AS disc, 0::BIGINT AS disc_types, count(*) FILTER (n = 1) AS unigrams, count(DISTINCT term) FILTER (n = 1) AS unigrams_types FROM found",
    "ngram_counts": f"WITH {TARGET}, {_runs('runs', 'tok_w', 1, 3)} SELECT term, n::INTEGER AS n, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM runs GROUP BY term, n",
    "doc_ngrams": f"WITH {TARGET}, {_found(least=1)} SELECT doc_id, term, n::INTEGER AS n, count(*) AS freq FROM found WHERE n <= 3 GROUP BY doc_id, term, n",
    "ngram_totals": f"WITH {TARGET}, {_model(5)} SELECT n::INTEGER AS n, sum(freq)::BIGINT AS total FROM model GROUP BY n",
    "aggregate_model": f"WITH {TARGET}, {REFERENCE}, {_model(3)}, {_model(3, MIN_FREQ, 'rmodel', 'rruns', 'rtok_w')} SELECT term, n::INTEGER AS n, sum(freq)::BIGINT AS freq FROM (SELECT * FROM model UNION ALL SELECT * FROM rmodel) GROUP BY term, n",
    "contingency": _uni("ab", "a_nb", "na_b", "na_nb"),
    "llr": _uni("llr"),
    "mi": _uni("mi"),
    "pmi": _uni("pmi"),
    "ngram_pmi": _uni("ngram_pmi"),
    "unithood": f"WITH {UNITHOOD} SELECT term, freq, freq_a, freq_b, round(llr, 6) AS llr, round(mi, 6) AS mi, round(pmi, 6) AS pmi, round(dice, 6) AS dice, round(term_coherence, 6) AS term_coherence, round(pmi + log10(freq) * 2, 6) AS combo FROM uni",
    "pmi_nl": f"WITH {TARGET}, {_model(5)}, big AS (SELECT * FROM model WHERE n > 1), {_sums('big', False)} SELECT term, round((ln((freq + 1.0) / ({N} + 1)) - word_logs) / (n - 1), 6) AS pmi_nl FROM big JOIN sums USING (term)",
    "dice": f"WITH {TARGET}, {_model(5)}, big AS (SELECT * FROM model WHERE n > 1), {_sums('big', False)} SELECT term, round(n * freq / nullif(words_freq, 0)::DOUBLE, 6) AS dice FROM big JOIN sums USING (term)",
    "term_coherence": f"WITH {TARGET}, {_model(5)}, big AS (SELECT * FROM model WHERE n > 1), {_sums('big', False)} SELECT term, round(log10(freq) * (n * freq / nullif(words_freq, 0)::DOUBLE), 6) AS term_coherence FROM big JOIN sums USING (term)",
    "glossex": f"WITH {TARGET}, {RMODEL}, {_model(5)}, big AS (SELECT * FROM model WHERE n > 1), {_sums('big', True)} SELECT term, round(glossex, 6) AS glossex FROM sums",
    "tf_idf": f"WITH {TARGET}, {CANDIDATES} SELECT term, round(freq * (SELECT count(DISTINCT doc_id) FROM found) / (docs + 1)::DOUBLE, 6) AS tf_idf FROM types",
    "weirdness": f"WITH {TARGET}, {RMODEL}, {_model(1)} SELECT m.term, round((m.freq + 1.0::DOUBLE) * ({RN} + 1) / ((coalesce(r.freq, 0) + 1.0::DOUBLE) * ({N} + 1)), 6) AS weirdness FROM model m LEFT JOIN rmodel r USING (term)",
    **{f"candidates_{f}": f"WITH {TARGET}, {_found(f, 1)}, {TYPES} SELECT term, n::INTEGER AS n, freq, docs FROM types" for f in FILTERS},
    "term_freq": f"WITH {TARGET}, {_found(least=1)}, {TYPES} SELECT term, freq FROM types",
    "doc_freq": f"WITH {TARGET}, {_found(least=1)}, {TYPES} SELECT term, docs FROM types",
    "rect_freq": f"WITH {TARGET}, {CANDIDATES}, {_levels()} SELECT term, n::INTEGER AS n, freq, rect_freq FROM nested",
    "c_value": f"WITH {TARGET}, {CANDIDATES}, {_levels()} SELECT term, n::INTEGER AS n, freq, round(c_value, 6) AS c_value FROM nested",
    "c_value_skips": f"WITH {TARGET}, {CANDIDATES}, {_levels(choices=True)} SELECT term, n::INTEGER AS n, freq, rect_freq, round(c_value, 6) AS c_value FROM nested",
    "metrics": f"WITH {METRICS} SELECT * FROM metrics",
    "rank_vote": f"WITH {VOTED} SELECT * REPLACE (round(vote, 6) AS vote) FROM voted",
    "topk": f"WITH {VOTED} SELECT term, round(vote, 6) AS vote, rank FROM (SELECT term, vote, row_number() OVER (ORDER BY vote DESC, term)::INTEGER AS rank FROM voted) WHERE rank <= 100",
    "keep_proportion": f"WITH {METRICS} SELECT term, c_value, rank FROM (SELECT term, c_value, row_number() OVER (ORDER BY c_value DESC NULLS LAST, term)::INTEGER AS rank, count(*) OVER () AS n FROM metrics) WHERE rank <= floor(n * 0.25)",
    "most_common": f"WITH {TARGET}, {CANDIDATES} SELECT term, freq FROM types ORDER BY freq DESC, term LIMIT 50",
    "rarest_above": f"WITH {TARGET}, {CANDIDATES} SELECT term, freq FROM types WHERE freq > 3 ORDER BY freq, term LIMIT 50",
    "filter_all": f"WITH {METRICS} SELECT term FROM metrics WHERE {_HELD} = 4",
    "filter_any": f"WITH {METRICS} SELECT term FROM metrics WHERE {_HELD} >= 1",
    "filter_majority": f"WITH {METRICS} SELECT term FROM metrics WHERE {_HELD} > 2",
    "filter_at_least": f"WITH {METRICS} SELECT term FROM metrics WHERE {_HELD} >= 3",
    "matcher": f"WITH {TARGET}, {LIST}, {CANDIDATES} SELECT term, term IN (SELECT term FROM lst) AS verified FROM types",
    "accept": f"WITH {METRICS}, {LIST} SELECT term, n::INTEGER AS n, freq, docs FROM types WHERE term IN (SELECT term FROM metrics WHERE {_HELD} = 4) OR term IN (SELECT term FROM lst)",
    "eval_types": f"WITH {TARGET}, {CANDIDATES}, {_levels()}, {GOLD}, {PREDICTED}, c AS (SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn FROM (SELECT term IN (SELECT term FROM predicted) AS p, term IN (SELECT term FROM gold) AS g FROM types)) SELECT tp, fp, fn, {_pr()} FROM c",
    "eval_corpus": f"""WITH {TARGET}, {CANDIDATES}, {_levels()}, {GOLD}, {PREDICTED},
p AS (SELECT DISTINCT doc_id, sent_id, tok_idx, n FROM found WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) AND term IN (SELECT term FROM predicted)),
g AS (SELECT DISTINCT doc_id, sent_id, tok_idx, n FROM gold WHERE doc_id IN (SELECT doc_id FROM p)),
b AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, p.doc_id IS NOT NULL AS ip, g.doc_id IS NOT NULL AS ig FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.sent_id = g.sent_id AND p.tok_idx = g.tok_idx AND p.n = g.n),
c AS (SELECT doc_id, count(*) FILTER (ip AND ig) AS tp, count(*) FILTER (ip AND NOT ig) AS fp, count(*) FILTER (NOT ip AND ig) AS fn FROM b GROUP BY doc_id),
s AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS re FROM c),
a AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(min(pr), 6) AS min_precision, round(max(pr), 6) AS max_precision, round(min(re), 6) AS min_recall, round(max(re), 6) AS max_recall FROM s)
SELECT *, {_pr()} FROM a""",
    "precision_at_k": f"WITH {METRICS}, {GOLD}, r AS (SELECT row_number() OVER (ORDER BY c_value DESC NULLS LAST, term) AS rank, term IN (SELECT term FROM gold) AS g FROM metrics), ks AS (SELECT DISTINCT least(k, (SELECT count(*) FROM r))::INTEGER AS k FROM unnest([10, 100, 1000]) t(k)) SELECT k, round(avg(g::INT), 6) AS precision FROM ks JOIN r ON rank <= k GROUP BY k",
    "error_analysis": f"""WITH {TARGET}, {LIST}, {CANDIDATES}, {_levels()}, {GOLD}, {PREDICTED}, gc AS (SELECT term, count(*) AS gf FROM gold GROUP BY term),
f AS (SELECT t.n, t.term IN (SELECT term FROM predicted) AS p, gf IS NOT NULL AS g, t.term IN (SELECT term FROM lst) AS l, gf FROM types t LEFT JOIN gc USING (term)),
c AS (SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, 0::BIGINT AS fp_elsewhere, count(*) FILTER (p AND NOT g AND l) AS fp_verified, count(*) FILTER (p AND NOT g AND l) AS fp_accounted,
  count(*) FILTER (NOT p AND g AND n > 4) AS fn_long, 0::BIGINT AS fn_tags, count(*) FILTER (NOT p AND g AND gf < {MIN_FREQ}) AS fn_rare, count(*) FILTER (NOT p AND g AND (n > 4 OR gf < {MIN_FREQ})) AS fn_accounted FROM f)
SELECT *, {_pr()}, round((tp + fp_accounted) / (tp + fp)::DOUBLE, 6) AS corrected_precision, round(tp / (tp + fn - fn_accounted)::DOUBLE, 6) AS corrected_recall FROM c""",
    "bridges": f"""WITH {TARGET}, {_model(2)}, {_found(least=3)}, w AS (SELECT DISTINCT string_split(term, ' ') AS l FROM found), pairs AS (SELECT DISTINCT l[i] AS a, l[j] AS b FROM w, range(1, 6) x(i), range(1, 6) y(j) WHERE j >= i + 2 AND j <= len(l)),
s AS (SELECT a, b, t.freq, ln((t.freq + 1.0) * ({N} + 1) / ((coalesce(x.freq, 0) + 1.0) * (coalesce(y.freq, 0) + 1))) + log10(t.freq) AS strength FROM pairs JOIN model t ON t.n = 2 AND t.term = a || ' ' || b LEFT JOIN model x ON x.n = 1 AND x.term = a LEFT JOIN model y ON y.n = 1 AND y.term = b)
SELECT a, b, freq, round(strength, 6) AS strength FROM s WHERE strength > 1 AND freq >= 1""",
    "coord_dcs": f"WITH RECURSIVE {TARGET}, {_model(2)}, {COORD_ALL} {_as_disc('coord')}",
    "hypernym_dcs": f"WITH RECURSIVE {TARGET}, {_model(2)}, {_found()}, {HYPER} {_as_disc('hyper')}",
    "extraction_run": f"""WITH RECURSIVE {METRICS}, {LIST}, {HYPER},
ever AS (SELECT doc_id, sent_id, range(tok_idx, tok_idx + n) AS pos, term, tags FROM found UNION SELECT * FROM coord UNION SELECT * FROM hyper),
acc AS (SELECT * FROM ever WHERE term IN (SELECT term FROM metrics WHERE {_HELD} = 4) OR term IN (SELECT term FROM lst)) {_as_disc('acc')}""",
    "dc_ranking": f"""WITH RECURSIVE {VOTED}, {COORD}, rk AS (SELECT term, {" + ".join(f"1.0::DOUBLE / rank_{r}" for r in RANKERS)} AS raw FROM ranks), dt AS (SELECT *, string_split(term, ' ') AS lem FROM coord),
de AS (SELECT lem[i] AS a, lem[i + 1] AS b FROM dt, range(1, 14) x(i) WHERE i < len(lem)), {_strong("dk", "de")},
dg AS (SELECT *, list_filter(range(1, len(pos)), lambda k: pos[k + 1] - pos[k] > 1)[1] AS k FROM dt),
dr AS (SELECT dg.*, round(coalesce(raw, 0.0), 6) AS vote, round(dk.strength, 6) AS strength FROM dg LEFT JOIN rk USING (term) LEFT JOIN dk ON dk.a = lem[k] AND dk.b = lem[k + 1]) {_as_disc('dr', ', vote, strength')}""",
    "skipgram_counts": f"WITH {TARGET}, {SKIPGRAMS} SELECT * FROM skips",
    "skipgram_freq": f"WITH {TARGET}, {_model(2, 5)}, {SKIPGRAMS}, s AS (SELECT replace(pattern, ' {{*}}', '') AS term, sum(freq) AS f FROM skips WHERE n_words = 2 GROUP BY 1) SELECT term, n::INTEGER AS n, freq, (freq + coalesce(f, 0))::BIGINT AS skip_freq FROM model LEFT JOIN s USING (term) WHERE n = 2",
    "subsequences": f"WITH {TARGET}, {_found(least=3)}, w AS (SELECT string_split(term, ' ') AS l FROM found) SELECT l[i] || ' ' || l[j] AS term, count(*) AS freq FROM w, range(1, 6) x(i), range(1, 6) y(j) WHERE j > i AND j <= len(l) GROUP BY 1",
    "annotations_at": f"WITH {_span_pieces('')} SELECT * FROM spans WHERE (start >= {SPAN[0]} AND start < {SPAN[1]}) OR (\"end\" > {SPAN[0]} AND \"end\" <= {SPAN[1]})",
    "overlaps": f"WITH {_span_pieces('')}, {_WINDOWS} SELECT v.doc_id, v.a AS start, v.b AS \"end\", s.start AS other_start, s.\"end\" AS other_end, word FROM win v JOIN spans s ON s.doc_id = v.doc_id AND s.start < v.b AND s.\"end\" > v.a AND NOT (s.start < v.a AND s.\"end\" > v.b)",
    "nearest_enclosing": f"""WITH {_span_pieces('')}, {_WINDOWS}, {_between("ln", chr(10))}, {_between("sn", _END)},
nodes AS (SELECT doc_id, 0 AS node_id, 'document' AS label, 0 AS a, length(text) AS b FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, i, 'line', a, b FROM ln UNION ALL SELECT doc_id, i + 999999, 'sentence', a, b FROM sn)
SELECT v.doc_id, v.a AS start, v.b AS "end", arg_max(label, (x.a, -x.b, node_id)) AS label, arg_max(node_id, (x.a, -x.b, node_id))::INTEGER AS node_id FROM win v LEFT JOIN nodes x ON x.doc_id = v.doc_id AND x.a <= v.a AND x.b >= v.b GROUP BY v.doc_id, v.a, v.b""",
    "kwic": f"WITH {_span_pieces('')} SELECT doc_id, start, replace(substring(text, greatest(0, start - 20) + 1, start - greatest(0, start - 20)) || '[[' || word || ']]' || substring(text, \"end\" + 1, 20), chr(10), ' ') AS context FROM spans JOIN documents USING (doc_id) WHERE word = '{KEYWORD}'",
    "quantiles": f"SELECT lang, {', '.join(f'round(quantile_cont(n_chars::DOUBLE, {q}), 6) AS {n}' for n, q in _Q)} FROM documents GROUP BY lang",
    "iqr_filter": "WITH q AS (SELECT quantile_cont(n_chars::DOUBLE, 0.25) AS a, quantile_cont(n_chars::DOUBLE, 0.75) AS b FROM documents) SELECT doc_id, n_chars FROM documents, q WHERE n_chars > a - 1.5 * (b - a) AND n_chars < b + 1.5 * (b - a)",
    "bigram_type": f"""WITH {TARGET}, {LIST}, {_model(2)}, {CANDIDATES}, c AS (SELECT DISTINCT array_to_string(list_slice(string_split(term, ' '), i, i + 1), ' ') AS term FROM types, range(1, 5) x(i) WHERE i < n),
l AS (SELECT DISTINCT term FROM bruns WHERE n = 2)
SELECT term, freq, CASE WHEN term IN (SELECT term FROM c) AND term IN (SELECT term FROM l) THEN 'both' WHEN term IN (SELECT term FROM c) THEN 'only_candidates' WHEN term IN (SELECT term FROM l) THEN 'only_list' ELSE 'neither' END AS kind FROM model WHERE n = 2""",
    "curate_docs": f"WITH {TARGET}, {LIST}, {_runs('runs', 'tok_w', 2, 5)} SELECT doc_id, count(DISTINCT term) AS terms FROM runs WHERE term IN (SELECT term FROM lst) GROUP BY doc_id HAVING count(DISTINCT term) > 2",
    "concept_counts": f"WITH {TARGET}, {_found()} SELECT term, count(DISTINCT doc_id) AS freq FROM found GROUP BY term",
    "concept_skips": f"""WITH {TARGET}, {CANDIDATES}, w AS (SELECT string_split(term, ' ') AS l FROM types WHERE n BETWEEN 3 AND 5), m AS (SELECT l, list_filter(range(1, 6), lambda i: i <= len(l)) AS r, unnest(range(1, 32)) AS mask FROM w),
p AS (SELECT l, list_filter(r, lambda i: (mask >> (i - 1)) & 1 = 1) AS ix FROM m WHERE mask < (1 << len(l))), t AS (SELECT l, array_to_string(list_transform(ix, lambda i: l[i]), ' ') AS term FROM p WHERE len(ix) BETWEEN 2 AND 4)
SELECT DISTINCT term FROM t WHERE term IN (SELECT term FROM types) AND NOT contains(' ' || array_to_string(l, ' ') || ' ', ' ' || term || ' ')""",
    "dice_over_log": f"WITH {UNITHOOD} SELECT term, CASE WHEN freq > 1 THEN round(2.0 * freq / (freq_a + freq_b), 6) END AS dice FROM uni",
    "docs_by_candidates": f"WITH {TARGET}, {_found()} SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id",
    "welch_t": f"WITH {_LABELLED}, m AS (SELECT flag, count(*) AS n, avg(v) AS mu, var_samp(v) AS s FROM lab GROUP BY flag), j AS (SELECT a.n AS n1, a.mu AS m1, a.s / a.n AS e1, b.n AS n2, b.mu AS m2, b.s / b.n AS e2 FROM m a, m b WHERE a.flag AND NOT b.flag) SELECT round((m1 - m2) / sqrt(e1 + e2), 6) AS t, round((e1 + e2) ** 2 / (e1 ** 2 / (n1 - 1) + e2 ** 2 / (n2 - 1)), 6) AS df FROM j",
    "mwu_u": f"WITH {_LABELLED}, r AS (SELECT flag, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM lab) SELECT round(sum(r) FILTER (flag) - count(*) FILTER (flag) * (count(*) FILTER (flag) + 1) / 2, 6) AS u, count(*) FILTER (flag) AS n1, count(*) FILTER (NOT flag) AS n2 FROM r",
    "welch_anova": f"WITH {_LABELLED}, m AS (SELECT lang, count(*) AS n, avg(v) AS mu, var_samp(v) AS s, count(*) / var_samp(v) AS w FROM lab GROUP BY lang HAVING count(*) > 1 AND var_samp(v) > 0), t AS (SELECT sum(w) AS sw, sum(w * mu) / sum(w) AS g, count(*) AS k FROM m), s AS (SELECT max(k) AS k, sum(w * (mu - g) ** 2) AS b, sum((1 - w / sw) ** 2 / (n - 1)) AS l FROM m, t) SELECT round(b / (k - 1) / (1 + 2 * (k - 2) / (k ** 2 - 1) * l), 6) AS f, k - 1 AS df1, round((k ** 2 - 1) / (3 * l), 6) AS df2 FROM s",
    "levene": f"WITH {_LABELLED}, z AS (SELECT lang, abs(v - quantile_cont(v, 0.5) OVER (PARTITION BY lang)) AS d FROM lab), m AS (SELECT lang, count(*) AS n, avg(d) AS mu, coalesce(var_samp(d), 0) AS s FROM z GROUP BY lang), t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * mu) / sum(n) AS g FROM m) SELECT round((max(nn) - max(k)) / (max(k) - 1) * sum(n * (mu - g) ** 2) / sum((n - 1) * s), 6) AS w FROM m, t",
    "tukey_pairs": f"WITH {_LABELLED}, m AS (SELECT lang, count(*) AS n, avg(v) AS mu, var_samp(v) AS s FROM lab GROUP BY lang), t AS (SELECT sum((n - 1) * s) / sum(n - 1) AS mse FROM m) SELECT a.lang AS a, b.lang AS b, round(a.mu - b.mu, 6) AS diff, round(sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 6) AS se, round(abs(a.mu - b.mu) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 6) AS q FROM m a JOIN m b ON a.lang < b.lang, t",
    "melted": f"SELECT lang, measure, value FROM (SELECT lang, {', '.join(f'round(quantile_cont(n_chars::DOUBLE, {q}), 6) AS {n}' for n, q in _Q[1:4])} FROM documents GROUP BY lang) UNPIVOT (value FOR measure IN (q25, q50, q75))",
}

def _one(name: str) -> str:
    """The one row of a statistic, before it is rounded."""
    return f"(SELECT * FROM ({ORACLE[name].replace('round(', '(').replace(', 6)', ')')}))"


ORACLE["p_values"] = f"""SELECT 'welch_t' AS test, round({_beta("df / 2", "0.5", "df / (df + t * t)")}, 6) AS p FROM {_one("welch_t")}
UNION ALL SELECT 'welch_anova', round({_beta("df2 / 2", "df1 / 2.0", "df2 / (df2 + df1 * f)")}, 6) FROM {_one("welch_anova")}
UNION ALL SELECT 'mwu_u', round(least(1, 2 * {_simpson("z", "z + 12", "exp(-x * x / 2) / sqrt(2 * pi())")}), 6) FROM (SELECT (abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0) AS z FROM {_one("mwu_u")})"""
ORACLE["effect_from_t"] = f"""WITH {_LABELLED}, c AS (SELECT count(*) FILTER (flag) AS n1, count(*) FILTER (NOT flag) AS n2 FROM lab), z AS (SELECT t * sqrt(1 / n1 + 1 / n2) / sqrt(2) AS z FROM c, {_one("welch_t")}),
k AS (SELECT z, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2)) AS k FROM z)
SELECT round((1 + sign(z) * (1 - k * (0.254829592::DOUBLE + k * (-0.284496736::DOUBLE + k * (1.421413741::DOUBLE + k * (-1.453152027::DOUBLE + k * 1.061405429::DOUBLE)))) * exp(-x * x))) / 2, 6) AS cles FROM k"""


def _horner(coefficients: tuple[float, ...], z: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {z} + {c!r}::DOUBLE)"
    return out


def _above(x: str) -> str:
    """The chance of a standard normal value above x, from the rational approximation that is good to 1e-15."""
    z = f"abs({x})"
    far = f"1 / (({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) * sqrt(2 * pi()))"
    upper = f"exp(-({z}) * {z} / 2) * CASE WHEN {z} < 7.07106781186547 THEN {_horner(HART, z)} / {_horner(HART_BELOW, z)} ELSE {far} END"
    return f"CASE WHEN {x} > 0 THEN {upper} ELSE 1 - {upper} END"


ORACLE["tukey_p"] = f"""WITH {_LABELLED}, m AS (SELECT lang, count(*) AS n FROM lab GROUP BY lang), g AS (SELECT count(*) AS k, sum(n - 1)::DOUBLE AS df FROM m),
u AS (SELECT a, b, q, k, df, r * i / 300 AS u, r / 300 AS du FROM (SELECT *, least(9, 9 / sqrt(2 * df)) AS r FROM {_one("tukey_pairs")}, g), range(-300, 301) t(i)),
z AS (SELECT z, {_above("z")} AS above FROM (SELECT i * 8.0::DOUBLE / 300 AS z FROM range(-300, 301) t(i))),
v AS (SELECT a, b, df, u, du, k, z, above, z - q * exp(u) AS y FROM u, z),
w AS (SELECT a, b, df, u, du, sum(k * exp(-z * z / 2) / sqrt(2 * pi()) * pow({_above("y")} - above, k - 1) * 8 / 300) AS below FROM v GROUP BY a, b, df, u, du)
SELECT a, b, round(greatest(0, 1 - sum(exp(ln(2) + df / 2 * ln(df / 2) - lgamma(df / 2) + df * u - df * exp(2 * u) / 2) * below * du)), 6) AS p FROM w GROUP BY a, b"""
