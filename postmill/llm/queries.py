"""The queries op1 .. op13, with production parameters over the whole tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from .conversations import COUNTS, conversation_audits, repair_conversations
from .decontamination import contamination
from .language import identify_language
from .mixing import mix_to_targets
from .nearest import nearest
from .neardup import near_duplicates
from .phrases import mine_phrases
from .quality import score_quality
from .records import token_records
from .repeats import remove_repeats
from .secret_scan import find_secrets
from .tokens import count_tokens
from .toxicity import score_toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark, sf_dir):
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_decontamination(spark, sf_dir):
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_token_counts(spark, sf_dir):
    return count_tokens(read(spark, sf_dir, "documents"), TOKENIZER)


def op4_secrets(spark, sf_dir):
    return find_secrets(read(spark, sf_dir, "documents"))


def op5_nearest(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_near_duplicates(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op7_quality(spark, sf_dir):
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_token_records(spark, sf_dir):
    return token_records(read(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def domains_of(docs, labels):
    """(doc_id, domain) of the labelled documents: their language and quality, which their texts show."""
    joined = docs.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id")
    return joined.select("doc_id", F.concat_ws("/", "lang", F.when(F.col("quality") == 1, "high").otherwise("low")).alias("domain"))


def op9_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return mix_to_targets(docs, domains_of(docs, read(spark, sf_dir, "labels")))


def op10_repeats(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"))


def op11_phrases(spark, sf_dir):
    return mine_phrases(read(spark, sf_dir, "documents"))


def op12_language(spark, sf_dir):
    return identify_language(read(spark, sf_dir, "documents"))


def damaged(conversations):
    """The turns as the contract of op13 damages them, by a hash of conversation and turn (nulls: one space)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("fate_") == 1, "").when(F.col("fate_") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("fate_") == 4, "user").otherwise(space("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("fate_") == 3, 2).otherwise(1))
    kept = conversations.select("conv_id", "turn", "role", "text", fate.alias("fate_")).where("fate_ != 0")
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def repaired(conversations):
    """The audit of every original conversation after its turns were damaged and repaired; zeros where no turn is left."""
    audits = conversation_audits(repair_conversations(damaged(conversations))).withColumnRenamed("conv_id", "id_")
    every = conversations.select("conv_id").distinct().join(audits, F.col("conv_id").eqNullSafe(F.col("id_")), "left")
    zeros = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS)
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark, sf_dir):
    return repaired(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_token_counts, op4_secrets, op5_nearest, op6_near_duplicates, op7_quality, op8_token_records, op9_mixing, op10_repeats, op11_phrases, op12_language, op13_conversation_repair)}
#: Words as the near-duplicate contract takes them: lower-cased A-Z, cut at ASCII white space.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""

_ITEM_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

_RULES = """(VALUES
  (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24), (3, 'owned', '[A-Za-z0-9+_-]{20,}', 0, 20)) r(no, kind, pat, grp, least)"""

SQL: dict[str, str] = {
    "op4_secrets": f"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS (SELECT t.*, no, kind, least,
  CASE no WHEN 0 THEN regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+') WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+')
    WHEN 2 THEN regexp_extract_all(t, '[0-9a-f]+') ELSE regexp_extract_all(t, '[A-Za-z0-9+_-]{{20,}}') END AS m,
  CASE no WHEN 0 THEN regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) ELSE NULL END AS v,
  CASE no WHEN 0 THEN string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+') WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]+')
    WHEN 2 THEN string_split_regex(t, '[0-9a-f]+') ELSE string_split_regex(t, '[A-Za-z0-9+_-]{{20,}}') END AS g FROM t, {_RULES}),
u AS (SELECT doc_id, source, lang, no, kind, least, unnest(m) AS m, unnest(coalesce(v, m)) AS v, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM m),
p AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id, no ORDER BY i) - length(m))::INT AS s FROM u),
x AS (SELECT doc_id, source, lang, no, kind, v, s, s + length(m) AS e FROM p WHERE length(v) >= least),
c AS (SELECT * FROM x WHERE no < 3 UNION ALL SELECT * FROM x a WHERE no = 3 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')
  AND len(list_distinct(string_split(v, ''))) >= 12 AND NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = a.doc_id AND b.no < 3 AND a.s < b.e AND b.s < a.e)),
o AS (SELECT *, owners >= 3 OR repositories >= 4 AS example FROM (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT coalesce(source, chr(0)) || chr(1) || coalesce(lang, chr(0))) AS repositories FROM c GROUP BY v)),
j AS (SELECT * FROM c JOIN o USING (v)),
a AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 3 OR owners = 1 AND NOT example) AS spans, max(owners) AS mo, max(repositories) AS mr,
  count(*) FILTER (owners = 1 AND NOT example AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 8) AS n_live, count(*) FILTER (example) AS n_examples FROM j GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_examples, 0)::BIGINT AS n_examples, coalesce(mo, 0)::BIGINT AS most_owners, coalesce(mr, 0)::BIGINT AS most_repositories FROM t LEFT JOIN a USING (doc_id)""",
    "op2_decontamination": f"""
WITH i AS (SELECT item_id::VARCHAR AS item, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, len(x) AS k, array_to_string(x, ' ') AS x FROM (
  SELECT item, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda p: w[p:p+9]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS x FROM i)),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT doc_id, p, k, item FROM (SELECT doc_id, k, p, array_to_string(w[p:p+k-1], ' ') AS x FROM places) JOIN win USING (k, x)),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_phrases": """
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS x FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM t)),
w AS (SELECT p, lang, unnest(x) AS w, unnest(range(len(x))) AS i FROM p),
v AS (SELECT lang, w AS u, lead(w, 1) OVER z AS v, lead(w, 2) OVER z AS x, lead(w, 3) OVER z AS y FROM w WINDOW z AS (PARTITION BY p ORDER BY i)),
f AS (SELECT lang, 1 AS k, u AS phrase, count(*) AS f FROM v GROUP BY ALL UNION ALL SELECT lang, 2, u || ' ' || v, count(*) FROM v WHERE v IS NOT NULL GROUP BY ALL
 UNION ALL SELECT lang, 3, u || ' ' || v || ' ' || x, count(*) FROM v WHERE x IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 4, u || ' ' || v || ' ' || x || ' ' || y, count(*) FROM v WHERE y IS NOT NULL GROUP BY ALL),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM f WHERE k >= 2 AND f >= 30),
x AS (SELECT *, unnest(range(1, k)) AS j FROM c),
y AS (SELECT x.lang, x.phrase, x.f, j, l.f AS l, r.f AS r, (2000000::HUGEINT * x.f // (l.f + r.f))::BIGINT AS score FROM x JOIN f l ON l.lang = x.lang AND l.k = j AND l.phrase = array_to_string(w[1:j], ' ') JOIN f r ON r.lang = x.lang AND r.k = x.k - j AND r.phrase = array_to_string(w[j+1:], ' ')),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS q FROM y) WHERE q = 1),
i AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, f, array_to_string(w[p:p+m-1], ' ') AS phrase FROM (SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS p FROM c, (VALUES (2), (3)) z(m) WHERE m < k)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.f DESC, s.phrase) AS rank, s.phrase, s.f AS a, s.l, s.r, n.n, s.score
      FROM s JOIN n USING (lang) LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.most IS NULL OR 100 * i.most < 80 * s.f)
SELECT * FROM o WHERE rank <= 2000""",
    "op6_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS k
      FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (an + bn - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
}
