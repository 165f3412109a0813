"""DuckDB statements equivalent to the queries of the core."""

from __future__ import annotations

from ..operators.runner import TEMPLATE
from ..operators.similarity import STOP_WORDS

B = """b AS (
  SELECT DISTINCT ON (id) id, dataset, lower(trim(split)) AS split, coalesce(question, '') AS question, choices, answerKey, subject,
         coalesce(len(choices.text), 0)::INT AS n_choices
  FROM questions ORDER BY id)"""
SEED = "md5(concat_ws('#', '42', {0}))"
SEED1 = "md5(concat_ws('#', '43', {0}))"
TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z]+|\\d+(?:[.,]\\d+)?'), lambda x: lower(x))"
BLANK = "[\\s\\p{Z}]"
WORDS = "len(list_filter(regexp_split_to_array({0}, '[\\s\\x0b\\x85\\p{{Z}}]+'), lambda w: w <> ''))"


def norm(column: str) -> str:
    return f"regexp_replace(lower(regexp_replace({column}, '^{BLANK}+|{BLANK}+$', '', 'g')), '{BLANK}+', ' ', 'g')"


def stable(sql: str) -> str:
    """Every value that is rounded half to even is rounded to nine digits before."""
    mark, out, at = "round_even(", "", 0
    while (start := sql.find(mark, at)) >= 0:
        depth, comma, k = 1, -1, start + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            comma = k if sql[k] == "," and depth == 1 else comma
            k += 1
        inner = stable(sql[start + len(mark) : comma])
        out += f"{sql[at:start]}{mark}round_even({inner}, 9){sql[comma:k]}"
        at = k
    return out + sql[at:]


def digits(text: str, modulus: int) -> str:
    steps = f"list_transform(string_split(sha256({text}), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)"
    return f"list_reduce(list_prepend(0::BIGINT, {steps}), lambda a, c: (a * 16 + c) % {modulus})"


# --- splits -------------------------------------------------------------------

POOLS = f"""{B},
n AS (SELECT * FROM b WHERE split IN ('train', 'validation', 'test')),
t AS (SELECT dataset, bool_or(split <> 'test') AS trained FROM n GROUP BY dataset),
g AS (SELECT dataset, left(question, 200) AS prefix, count(*) AS c FROM n JOIN t USING (dataset) WHERE NOT trained GROUP BY ALL),
h AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY dataset ORDER BY {SEED.format('prefix')}, prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
pools AS (
  SELECT n.*, CASE WHEN trained THEN CASE WHEN split = 'test' THEN 'test' ELSE 'train' END WHEN h.prefix IS NULL THEN 'train' ELSE 'test' END AS pool
  FROM n JOIN t USING (dataset) LEFT JOIN h ON h.dataset = n.dataset AND h.prefix = left(n.question, 200) AND h.before < 1000)"""


def stratified(source: str, name: str, n: int, stratum: str = "subject") -> str:
    return f"""
{name}_a AS (SELECT *, CASE WHEN count({stratum}) OVER (PARTITION BY dataset) > 0 THEN coalesce({stratum}, 'nan') ELSE '' END AS s, count(*) OVER (PARTITION BY dataset) AS total FROM {source}),
{name}_b AS (SELECT *, count(*) OVER (PARTITION BY dataset, s) AS c, row_number() OVER (PARTITION BY dataset, s ORDER BY {SEED.format('id')}, id) AS own FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN own > least(greatest(round_even(least({n}, total) * c / total, 0), 1), c) THEN 1 ELSE 0 END AS late FROM {name}_b),
{name} AS (SELECT * FROM {name}_c QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY late, {SEED1.format('id')}, id) <= {n})"""


BUILD = f"""{POOLS},{stratified("(SELECT * FROM pools WHERE pool = 'train')", 'tr', 1000)},
banned AS (SELECT dataset, left(question, 200) AS x FROM tr UNION SELECT dataset, question FROM tr),
cand AS (SELECT * FROM pools p WHERE pool = 'test'
  AND NOT EXISTS (SELECT 1 FROM banned WHERE banned.dataset = p.dataset AND x = left(p.question, 200))
  AND NOT EXISTS (SELECT 1 FROM banned WHERE banned.dataset = p.dataset AND x = p.question)),{stratified('cand', 'te', 250)},
fz AS (SELECT id, dataset, 'train' AS piece, question FROM tr UNION ALL SELECT id, dataset, 'test', question FROM te)"""

# --- vectors ------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def terms(source: str) -> str:
    return f"""(SELECT dataset, id, term, count(*) AS n FROM (SELECT dataset, id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source})
  WHERE term NOT IN ({STOP}) GROUP BY ALL)"""


DRAWN = f"{B}, drawn AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {SEED.format('id')}, id) <= 300)"
def weights(source: str) -> str:
    return f"""tc AS {terms(source)},
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY term ORDER BY sum(n) DESC, term LIMIT 20000),
raw AS (SELECT dataset, id, term, (1 + ln(n)) * idf AS w FROM tc JOIN idf USING (term)),
w AS (SELECT dataset, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


TFIDF = f"{DRAWN}, {weights('drawn')}"
COHESION = """
s AS (SELECT dataset, term, sum(w) AS s FROM w GROUP BY ALL), z AS (SELECT dataset, count(DISTINCT id) AS n FROM w GROUP BY ALL),
dots AS (SELECT x.dataset AS a, y.dataset AS b, sum(x.s * y.s) AS dot FROM s x JOIN s y USING (term) GROUP BY ALL),
coh AS (SELECT x.dataset AS a, y.dataset AS b,
  round_even(CASE WHEN x.dataset = y.dataset THEN (coalesce(dot, 0) - x.n) / nullif(x.n * (x.n - 1), 0) ELSE coalesce(dot, 0) / (x.n * y.n) END, 3) + 0.0 AS cohesion
  FROM z x CROSS JOIN z y LEFT JOIN dots ON dots.a = x.dataset AND dots.b = y.dataset)"""
RETRIEVAL = f"""{BUILD},
xc AS {terms('tr')}, yc AS {terms('te')},
docs AS (SELECT dataset, count(*) AS docs FROM tr GROUP BY ALL),
xi AS (SELECT dataset, term, ln((1 + any_value(docs)) / (1 + count(*))) + 1 AS idf FROM xc JOIN docs USING (dataset) GROUP BY dataset, term
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sum(n) DESC, term) <= 20000),
xw AS (SELECT dataset, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY dataset, id)) AS w FROM (SELECT dataset, id, term, (1 + ln(n)) * idf AS w FROM xc JOIN xi USING (dataset, term))),
yw AS (SELECT dataset, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY dataset, id)) AS w FROM (SELECT dataset, id, term, (1 + ln(n)) * idf AS w FROM yc JOIN xi USING (dataset, term))),
sim AS (SELECT yw.dataset, yw.id, xw.id AS train_id, sum(yw.w * xw.w) AS sim FROM yw JOIN xw USING (dataset, term) GROUP BY ALL),
best AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY dataset, id ORDER BY sim DESC, train_id) <= 5),
top AS (SELECT te.dataset, te.id, round_even(coalesce(max(sim), 0), 6) AS top1, round_even(coalesce(sum(sim) / least(5, any_value(docs)), 0), 6) AS top_k_mean
  FROM te LEFT JOIN best USING (dataset, id) LEFT JOIN docs ON docs.dataset = te.dataset GROUP BY te.dataset, te.id),
rep AS (SELECT dataset, count(*) AS n, round_even(avg(top1), 3) AS mean_top1, round_even(median(top1), 3) AS median_top1, round_even(quantile_cont(top1, 0.9), 3) AS p90_top1,
  round_even(avg(top_k_mean), 3) AS mean_top_k, round_even(avg((top1 >= 0.3)::INT) * 100, 1) AS percent_near FROM top GROUP BY dataset)"""

# --- extraction -----------------------------------------------------------------

NUM = "^[+-]?(\\d+(_\\d+)*(\\.(\\d+(_\\d+)*)?)?|\\.\\d+(_\\d+)*)(e[+-]?\\d+(_\\d+)*)?$"


def norm_value(column: str) -> str:
    plain = f"regexp_replace(regexp_replace(lower({column}), '[\\s\\p{{Z}},$]', '', 'g'), '\\.+$', '')"
    number = f"CASE WHEN regexp_matches({plain}, '{NUM}') THEN try_cast(replace({plain}, '_', '') AS DOUBLE) END"
    return (
        f"CASE WHEN ({number}) = 0 THEN '0' WHEN ({number}) IS NOT NULL THEN printf('%.5e', {number}) WHEN regexp_matches({plain}, '^[+-]?nan$') THEN 'nan' "
        f"WHEN regexp_matches({plain}, '^\\+?inf(inity)?$') THEN 'inf' WHEN regexp_matches({plain}, '^-inf(inity)?$') THEN '-inf' ELSE {plain} END"
    )


def last(text: str, pattern: str, group: int, flags: str = "") -> str:
    return f"list_extract(regexp_extract_all({text}, {pattern}, {group}), -1)"


def letter(lead: str) -> str:
    return f"upper({last('t', f"""'(?i){lead}\\s*[:\\-]?\\s*\\(?([' || lab || '])\\b\\)?'""", 1)})"


EXTRACT = f"""
c0 AS (SELECT key, labels, texts, array_to_string(labels, '') AS lab,
  regexp_replace(raw, '(?s)<think>.*?(?:</think>|$)', '', 'g') AS t FROM src),
c1 AS (SELECT *, CASE WHEN lab <> '' THEN {letter('FINAL\\s*ANSWER')} END AS m1, CASE WHEN lab <> '' THEN {letter('(?:the\\s+)?answer\\s+is')} END AS m2,
  CASE WHEN lab <> '' THEN {letter('(?:correct\\s+option|option)')} END AS m3,
  coalesce({last('t', "'(?i)FINAL\\s*ANSWER\\s*[:\\-]?\\s*(.+)'", 1)}, {last('t', "'(?i)(?:the\\s+)?answer\\s+is\\s*[:\\-]?\\s*([^\\n.]+)'", 1)}) AS cand,
  CASE WHEN lab <> '' THEN {last("right(t, 200)", "'(?m)\\([' || lab || ']\\)|(?:^|\\s)[' || lab || '][).:]?\\s*$'", 0)} END AS tail FROM c0),
c2 AS (SELECT *, {norm_value('cand')} AS v FROM c1),
c3 AS (SELECT *, list_filter(list_zip(labels, texts, true), lambda p: p[1] IS NOT NULL AND p[2] IS NOT NULL AND {norm_value('p[2]')} = v) AS hits FROM c2),
c4 AS (SELECT key, labels, m1, m2, m3, CASE WHEN v <> '' AND len(hits) = 1 THEN hits[1][1] END AS m4, upper(nullif(regexp_replace(tail, '[\\s().:]', '', 'g'), '')) AS m5 FROM c3),
ex AS (SELECT key, labels, coalesce(m1, m2, m3, m4, m5) AS pred, CASE WHEN m1 IS NOT NULL THEN 'final_answer' WHEN m2 IS NOT NULL THEN 'answer_is' WHEN m3 IS NOT NULL THEN 'option'
  WHEN m4 IS NOT NULL THEN 'value_match' WHEN m5 IS NOT NULL THEN 'tail_letter' END AS method FROM c4)"""
UPPER = "list_transform(choices.label, lambda x: upper(x))"

# --- prompts and mock ------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINES = "coalesce(array_to_string(list_filter(list_transform(list_zip(choices.label, choices.text, true), lambda p: CASE WHEN p[1] IS NULL OR p[2] IS NULL THEN NULL ELSE p[1] || ') ' || p[2] END), lambda x: x IS NOT NULL), chr(10)), '')"
_before, _rest = TEMPLATE.split("{question}")
_between, _after = _rest.split("{options}")
PROMPT = f"{quoted(_before)} || question || {quoted(_between)} || {LINES} || {quoted(_after)}"
MOCK = f"""{B}, m0 AS (SELECT alias AS model, hf_id, b.*, {digits("alias || '|' || id", 29100)} AS h FROM b CROSS JOIN model_registry WHERE split = 'test'),
m1 AS (SELECT *, 'This answer is made up for a trial run, without a look at the question (' || (h % 97) || ').' ||
  CASE WHEN h % 10 <> 0 AND len(choices.label) > 0 AND choices.label[h % len(choices.label) + 1] IS NOT NULL THEN chr(10) || 'FINAL ANSWER: ' || choices.label[h % len(choices.label) + 1]
  ELSE chr(10) || 'The last line is left out on purpose.' END AS raw FROM m0)"""

R = "r AS (SELECT * REPLACE (lower(trim(split)) AS split) FROM responses)"
K = "model IS NOT NULL AND dataset IS NOT NULL AND split IS NOT NULL"
RATE = "round_even(avg(correct::INT), 3) AS accuracy, round_even(1 - avg(valid::INT), 3) AS invalid, round_even(avg(strict_format::INT), 3) AS strict, round_even(avg(wall_time_s), 3) AS mean_latency_s"
PASSAGES = f"""{B}, x AS (SELECT id, any_value(context) AS context FROM questions GROUP BY id), p AS (SELECT split, id AS key, coalesce(context, CASE WHEN strpos(question, chr(10) || chr(10)) > 0 THEN left(question, strpos(question, chr(10) || chr(10)) - 1) END, '') AS text,
  CASE WHEN strpos(question, chr(10) || chr(10)) > 0 THEN substr(question, strpos(question, chr(10) || chr(10)) + 2) ELSE question END AS question, nullif(strpos('ABCD', coalesce(answerKey, '?')), 0) AS i,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN contains(s, 'categorical') THEN 'categorical' END, CASE WHEN contains(s, 'sufficient') THEN 'sufficient' END, CASE WHEN contains(s, 'necessry') THEN 'necessry' END,
    CASE WHEN contains(s, 'disjunctive') THEN 'disjunctive' END, CASE WHEN contains(s, 'conjunctive') THEN 'conjunctive' END], lambda x: x IS NOT NULL), '+'), ''), 'unspecified') AS label
  FROM (SELECT *, lower(coalesce(subject, '')) AS s FROM b LEFT JOIN x USING (id)) WHERE dataset = 'logiqa2' AND split IS NOT NULL)"""
STRIP = f"regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g')"

STATEMENTS = {
    "mcq_canonical": f"""WITH {B} SELECT id, dataset, split, n_choices, array_to_string(choices.label, '|') AS labels, array_to_string(choices.text, '|') AS texts,
        answerKey AS answer_key, coalesce(subject, 'nan') AS subject FROM b""",
    "question_integrity": """SELECT dataset, count(*) AS n, count(*) - count(id) AS null_id, count(*) - count(question) AS null_question, count(*) - count(answerKey) AS null_key,
        count(*) FILTER (choices IS NULL) AS null_choices, count(*) FILTER (len(choices.label) <> len(choices.text)) AS unequal_choices FROM questions GROUP BY dataset""",
    "stem_conversion": f"""WITH {B} SELECT printf('obqa_%s_%05d', split, row_number() OVER (PARTITION BY split ORDER BY id) - 1) AS id, question, split, answerKey AS answer_key
        FROM b WHERE dataset = 'openbookqa' AND split IS NOT NULL""",
    "passage_conversion": f"""WITH {PASSAGES} SELECT printf('logiqa2_%s_%05d', split, row_number() OVER (PARTITION BY split ORDER BY key) - 1) AS id, split,
        {STRIP} || chr(10) || chr(10) || question AS question, {STRIP} AS context, substr('ABCD', i, 1) AS answer_key, label AS subject FROM p""",
    "logical_type_labels": f"WITH {PASSAGES} SELECT label, count(*) AS n FROM p GROUP BY label",
    "file_splits": f"""WITH {B}, f AS (SELECT dataset || '_' || upper(left(coalesce(split, 'x'), 1)) || substr(coalesce(split, 'x'), 2) || '.parquet' AS file FROM b)
        SELECT file, CASE WHEN contains(lower(file), 'train') THEN 'train' WHEN contains(lower(file), 'valid') OR contains(lower(file), 'dev') THEN 'validation' ELSE 'test' END AS split,
        CASE WHEN contains(file, 'train') THEN 'train' WHEN contains(file, 'valid') OR contains(file, 'dev') THEN 'validation' WHEN contains(file, 'test') THEN 'test' ELSE 'unknown' END AS strict_split,
        count(*) AS n FROM f GROUP BY ALL""",
    "split_overview": f"""WITH {B}, m AS (SELECT dataset, n_choices FROM (SELECT dataset, n_choices, count(*) AS k FROM b GROUP BY dataset, n_choices) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY k DESC, n_choices) = 1),
        c AS (SELECT dataset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM b GROUP BY dataset)
        SELECT dataset, train, validation, test, train + validation + test AS total, train + validation AS train_validation, n_choices FROM c JOIN m USING (dataset)""",
    "answer_key_distribution": f"""WITH {B} SELECT dataset, answerKey AS answer_key, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY dataset), 3) AS share FROM b GROUP BY dataset, answerKey""",
    "text_stats": f"""WITH {B}, t AS (SELECT dataset, id, {TOKENS.format('question')} AS bag FROM b),
        l AS (SELECT dataset, count(*) AS n, round_even(avg(len(bag)), 3) AS mean_tokens, median(len(bag)) AS median_tokens,
          round_even(avg(len(list_filter(bag, lambda x: regexp_matches(x, '^\\d'))) / greatest(len(bag), 1)), 3) AS numeric_density FROM t GROUP BY dataset),
        v AS (SELECT dataset, count(DISTINCT w) AS vocabulary FROM (SELECT dataset, unnest(bag) AS w FROM t) GROUP BY dataset),
        d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {SEED.format('id')}, id) <= 200),
        u AS (SELECT dataset, count(DISTINCT w) AS sample_vocabulary, round_even(count(DISTINCT w) / nullif(count(w), 0), 3) AS type_token_ratio FROM (SELECT dataset, unnest(bag) AS w FROM d) GROUP BY dataset)
        SELECT * FROM l LEFT JOIN v USING (dataset) LEFT JOIN u USING (dataset)""",
    "option_length_stats": f"""WITH {B}, o AS (SELECT dataset, list_sum(list_transform(choices.text, lambda x: len(regexp_extract_all(coalesce(x, ''), '[A-Za-z]+|\\d+(?:[.,]\\d+)?')))) / nullif(len(choices.text), 0) AS l FROM b)
        SELECT dataset, round_even(avg(l), 3) AS mean_option_tokens, round_even(median(l), 3) AS median_option_tokens FROM o GROUP BY dataset""",
    "vocab_jaccard": f"""WITH {DRAWN}, w AS (SELECT DISTINCT dataset, unnest({TOKENS.format('question')}) AS w FROM drawn), z AS (SELECT dataset, count(*) AS n FROM w GROUP BY dataset),
        o AS (SELECT x.dataset AS a, y.dataset AS b, count(*) AS o FROM w x JOIN w y USING (w) GROUP BY ALL)
        SELECT x.dataset AS a, y.dataset AS b, round_even(coalesce(o, 0) / (x.n + y.n - coalesce(o, 0)), 3) AS jaccard FROM z x CROSS JOIN z y LEFT JOIN o ON o.a = x.dataset AND o.b = y.dataset""",
    "leakage_profile": f"""WITH {B}, p AS (SELECT dataset, left(question, 200) AS p, count(*) AS n, bool_or(coalesce(split IN ('train', 'validation'), false)) AS tr, bool_or(coalesce(split = 'test', false)) AS te FROM b GROUP BY ALL)
        SELECT dataset, sum(n)::BIGINT AS n, count(*) AS prefixes, max(n) AS most_per_prefix, sum((tr AND te)::INT)::BIGINT AS shared_prefixes FROM p GROUP BY dataset""",
    "dedup_exact": f"WITH {B} SELECT id, dataset FROM b QUALIFY row_number() OVER (PARTITION BY {norm('question')} ORDER BY id) = 1",
    "decontaminate": f"""WITH {B} SELECT id, dataset FROM b WHERE split IN ('train', 'validation') AND {norm('question')} NOT IN (SELECT {norm('question')} FROM b WHERE split = 'test')""",
    "uniform_sample": f"WITH {B} SELECT id, dataset FROM b QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {SEED.format('id')}, id) <= 200",
    "half_split": f"""WITH {B} SELECT id, dataset, (row_number() OVER (PARTITION BY dataset ORDER BY {SEED.format('id')}, id) > floor(count(*) OVER (PARTITION BY dataset) / 2))::INT AS half FROM b WHERE split = 'test'""",
    "stratified_train_sample": f"WITH {BUILD} SELECT id, dataset FROM tr",
    "group_split": f"WITH {POOLS} SELECT id, dataset, pool FROM pools",
    "antileak_test_candidates": f"WITH {BUILD} SELECT id, dataset FROM cand",
    "frozen_splits": f"WITH {BUILD} SELECT id, dataset, piece FROM fz",
    "split_manifest": f"""WITH {BUILD}, gone AS (SELECT dataset, count(*) FILTER (pool = 'test') - (SELECT count(*) FROM cand c WHERE c.dataset = p.dataset) AS gone FROM pools p GROUP BY dataset)
        SELECT dataset, piece, count(*) AS n, 42 AS seed, left(sha256(string_agg(id, '' ORDER BY id)), 12) AS sha, CASE WHEN piece = 'test' THEN any_value(gone) ELSE 0 END AS removed_for_leaks
        FROM fz JOIN gone USING (dataset) GROUP BY dataset, piece""",
    "split_disjointness": f"""WITH {BUILD}
        SELECT te.dataset, count(DISTINCT te.id) FILTER (te.id IN (SELECT id FROM tr)) AS shared_ids,
          count(DISTINCT te.question) FILTER (EXISTS (SELECT 1 FROM tr WHERE tr.dataset = te.dataset AND tr.question = te.question)) AS shared_texts,
          count(DISTINCT left(te.question, 200)) FILTER (EXISTS (SELECT 1 FROM tr WHERE tr.dataset = te.dataset AND left(tr.question, 200) = left(te.question, 200))) AS shared_prefixes
        FROM te GROUP BY te.dataset""",
    "prompt_render": f"WITH {B} SELECT id, {PROMPT} AS prompt, left(sha256({quoted(TEMPLATE)}), 12) AS prompt_sha FROM b",
    "mock_responses": f"WITH {MOCK} SELECT model, id, raw AS raw_response, round_even(0.01 + (h % 100) / 1000, 3) AS wall_time_s, {WORDS.format('raw')}::INT AS gen_tokens FROM m1",
    "mock_run_records": f"""WITH {MOCK}, src AS (SELECT {{'m': model, 'i': id, 'g': upper(coalesce(answerKey, 'NONE'))}} AS key, {UPPER} AS labels, choices.text AS texts, raw FROM m1), {EXTRACT}
        SELECT key.m AS model, key.i AS id, key.g AS gold, pred, pred IS NOT NULL AS valid, method AS extraction_method, coalesce(method = 'final_answer', false) AS strict_format,
        pred IS NOT DISTINCT FROM key.g AS correct, true AS mock FROM ex""",
    "extract_answers": f"""WITH b AS (SELECT DISTINCT ON (id) id, choices FROM (SELECT id, choices FROM questions UNION ALL SELECT id, choices FROM anchor_questions) ORDER BY id),
        src AS (SELECT rec_id AS key, {UPPER} AS labels, choices.text AS texts, raw_response AS raw FROM responses LEFT JOIN b USING (id)), {EXTRACT} SELECT key AS rec_id, pred, method FROM ex""",
    "normal_values": f"WITH {B}, t AS (SELECT DISTINCT unnest(choices.text) AS value FROM b) SELECT value, {norm_value('value')} AS norm FROM t WHERE value IS NOT NULL",
    "string_functions": f"""WITH {B}, t AS (SELECT *, {TOKENS.format('question')} AS bag FROM b)
        SELECT id, regexp_replace(regexp_replace(lower(dataset || ' ' || question), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, left(question, 200) AS prefix, right(question, 200) AS tail,
        {norm('question')} AS norm, {WORDS.format('question')}::INT AS words, len(bag)::INT AS tokens,
        round_even(len(list_filter(bag, lambda x: regexp_matches(x, '^\\d'))) / greatest(len(bag), 1), 6) AS density, left(sha256(question), 12) AS sha, {digits('question', 97)} AS mod97 FROM t""",
    "run_metrics": f"WITH {R} SELECT model, dataset, split, count(id) AS n, {RATE} FROM r WHERE {K} GROUP BY ALL",
    "run_metrics_full": f"""WITH {R} SELECT model, dataset, split, count(id) AS n, {RATE}, round_even(quantile_cont(wall_time_s, 0.5), 3) AS p50_latency_s, round_even(quantile_cont(wall_time_s, 0.95), 3) AS p95_latency_s,
        round_even(avg(gen_tokens), 3) AS mean_gen_tokens, round_even(avg(gen_tokens / nullif(wall_time_s, 0)), 3) AS tokens_per_s, round_even(avg({WORDS.format('raw_response')}), 3) AS reasoning_words
        FROM r WHERE {K} GROUP BY ALL""",
    "accuracy_by_length_quartile": f"""WITH r AS (SELECT model, dataset, correct, {WORDS.format('raw_response')} AS w FROM responses WHERE model IS NOT NULL AND dataset IS NOT NULL),
        e AS (SELECT list_distinct(quantile_cont(w, [0, 0.25, 0.5, 0.75, 1])) AS e FROM r), f AS (SELECT list_sort(e)[2:-2] AS inner_edges FROM e)
        SELECT model, dataset, len(list_filter(inner_edges, lambda x: x < w))::INT AS bin, count(*) AS n, round_even(avg(correct::INT), 3) AS accuracy FROM r CROSS JOIN f WHERE w IS NOT NULL GROUP BY ALL""",
    "prediction_bias": """SELECT model, pred, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY model), 3) AS share FROM responses WHERE valid AND model IS NOT NULL AND pred IS NOT NULL GROUP BY model, pred""",
    "extraction_method_share": """SELECT model, extraction_method, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY model), 3) AS share FROM responses WHERE model IS NOT NULL GROUP BY model, extraction_method""",
    "latency_box": """WITH v AS (SELECT dataset, model, wall_time_s AS v FROM responses WHERE dataset IS NOT NULL AND model IS NOT NULL AND wall_time_s IS NOT NULL),
        q AS (SELECT dataset, model, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY ALL)
        SELECT dataset, model, round_even(min(v), 6) AS low, round_even(q1, 6) AS q1, round_even(q2, 6) AS q2, round_even(q3, 6) AS q3, round_even(max(v), 6) AS high
        FROM v JOIN q USING (dataset, model) WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) GROUP BY dataset, model, q1, q2, q3""",
    "reasoning_histogram": f"""WITH w AS (SELECT model, {WORDS.format('raw_response')} AS w FROM responses WHERE model IS NOT NULL AND raw_response IS NOT NULL), e AS (SELECT min(w) AS lo, max(w) AS hi FROM w)
        SELECT model, coalesce(least(floor((w - lo) * 40 / nullif(hi - lo, 0)), 39), 0)::INT AS bin, count(*) AS n FROM w CROSS JOIN e GROUP BY ALL""",
    "accuracy_interval": """WITH p AS (SELECT dataset, model, count(correct) AS n, avg(correct::INT) AS p FROM responses WHERE dataset IS NOT NULL AND model IS NOT NULL GROUP BY ALL)
        SELECT dataset, model, n, round_even(p, 3) AS accuracy, round_even(p - 1.96 * sqrt(p * (1 - p) / nullif(n, 0)), 3) AS low, round_even(p + 1.96 * sqrt(p * (1 - p) / nullif(n, 0)), 3) AS high FROM p""",
    "any_mock": "SELECT coalesce(bool_or(mock), false) AS any_mock FROM responses",
    "resume_todo": f"""WITH {B}, {R} SELECT alias AS model, dataset, split, id FROM b CROSS JOIN model_registry
        WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.model = alias AND r.dataset = b.dataset AND r.split = b.split AND r.id = b.id)""",
    "plan_cost": f"""WITH {B}, c AS (SELECT dataset, split, count(*) * (SELECT count(*) FROM model_registry) AS calls FROM b GROUP BY ALL)
        SELECT dataset, split, calls, round_even(calls * 2.0::DOUBLE / 3600, 3) AS hours_low, round_even(calls * 15.0::DOUBLE / 3600, 3) AS hours_high FROM c""",
    "tfidf_weights": f"WITH {B}, {weights('b')} SELECT id, term, round_even(w, 6) AS w FROM w",
    "retrieval_top1": f"WITH {RETRIEVAL} SELECT dataset, id, top1 FROM top",
    "retrieval_top5": f"WITH {RETRIEVAL} SELECT dataset, id, top_k_mean FROM top",
    "retrieval_report": f"WITH {RETRIEVAL} SELECT * FROM rep",
    "tfidf_cohesion": f"WITH {TFIDF}, {COHESION} SELECT a, b, cohesion FROM coh",
    "embedding_cosine_top1": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query, x.vec_id AS neighbour, list_cosine_similarity(q.v, x.v) AS c FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query, neighbour, round_even(c, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) = 1""",
    "embedding_cohesion": """WITH e AS (SELECT label AS dataset, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
        w AS (SELECT dataset, id, unnest(range(len(v))) AS term, unnest(v) / sqrt(list_dot_product(v, v)) AS w FROM e WHERE list_dot_product(v, v) > 0), """
    + COHESION
    + " SELECT a, b, cohesion FROM coh",
    "impact_score": f"""WITH {RETRIEVAL}, {TFIDF.removeprefix(B + ', ')}, {COHESION},
        dens AS (SELECT dataset, round_even(avg(len(list_filter(bag, lambda x: regexp_matches(x, '^\\d'))) / greatest(len(bag), 1)), 3) AS numeric_density FROM (SELECT dataset, {TOKENS.format('question')} AS bag FROM b) GROUP BY dataset),
        tab AS (SELECT dataset, dominant_reasoning, error_type, numeric_density, cohesion, mean_top1 FROM dataset_registry FULL JOIN dens USING (dataset)
          FULL JOIN (SELECT a AS dataset, cohesion FROM coh WHERE a = b) USING (dataset) FULL JOIN (SELECT dataset, mean_top1 FROM rep) USING (dataset)),
        sc AS (SELECT *, (2 * coalesce(error_type = 'process', false)::INT + coalesce(mean_top1 >= (SELECT median(mean_top1) FROM tab), false)::INT + coalesce(cohesion >= (SELECT median(cohesion) FROM tab), false)::INT)::INT AS score FROM tab)
        SELECT *, CASE WHEN score <= 1 THEN 'low' WHEN score = 2 THEN 'medium' ELSE 'high' END AS impact FROM sc""",
}

for _name in ("run_metrics", "run_metrics_full", "accuracy_by_length_quartile", "prediction_bias", "extraction_method_share", "latency_box", "accuracy_interval"):
    STATEMENTS[_name] = stable(STATEMENTS[_name])
