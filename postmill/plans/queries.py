"""Named queries over the driver's tables, one for each operator, and the same in SQL.

Texts with a known answer: ``ads`` builds labelled posts from part, supplier and nation, the same way in both engines, with
variants that lack a phone, a company, labels, or name several roles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import contacts, forms, hashing, lines, text
from ..functions.decoding import decode_accumulating
from ..operators import about_details, caption, channel_posts, dedup, jobs, listing_posts, narrative, publication, semi_structured
from ..operators.field_only import parse_field_only, with_details
from ..operators.source_details import source_details
from ..operators.structured import detect_label, is_multi_role, parse_structured, with_own_details
from ..sources import channel as channel_source
from ..sources import tables
from ..sources.messages import decode_raw, encode_raw

QUERIES: dict = {}
SQL: dict[str, str] = {}
APOSTROPHE = chr(0x2018)
_FIRM = "'Firma' || s_suppkey"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


ADS_SQL = f"""ads AS (
SELECT p_partkey AS k, p_partkey % 8 AS v, p_name, s_name, n_name, p_size, s_suppkey,
 concat_ws(chr(10),
  CASE WHEN p_partkey % 8 = 3 THEN p_name || ' / ' || p_brand WHEN p_partkey % 8 = 4 THEN p_name || chr(10) || p_brand WHEN p_partkey % 8 = 5 THEN NULL ELSE '👤 Lavozim: ' || p_name END,
  CASE WHEN p_partkey % 8 <> 1 THEN '🏢 Kompaniya: ' || s_name END,
  CASE WHEN p_partkey % 8 <> 7 THEN '💰 Maosh: ' || p_size || ' 000 000 so{APOSTROPHE}m' END,
  CASE WHEN p_partkey % 8 <> 7 THEN CASE WHEN p_partkey % 8 = 6 THEN 'Манзил: ' ELSE '📍 Manzil: ' END || n_name END,
  CASE WHEN p_partkey % 8 <> 7 THEN '⏰ Ish vaqti: 09:00 - 18:00' END,
  CASE WHEN p_partkey % 8 <> 2 THEN 'Telefon: +99890' || lpad(p_partkey::VARCHAR, 7, '0') END,
  'Murojaat: @hr_' || s_suppkey) AS description
FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = s_nationkey)"""


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier, nation = (read(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    n = supplier.count()
    v, text_ = F.col("p_partkey") % 8, F.concat
    rows = part.join(supplier, F.col("s_suppkey") == F.col("p_partkey") % n).join(F.broadcast(nation), F.col("n_nationkey") == F.col("s_nationkey"))
    lit = F.lit
    described = F.concat_ws(
        "\n",
        F.when(v == 3, text_("p_name", lit(" / "), "p_brand")).when(v == 4, text_("p_name", lit("\n"), "p_brand")).when(v != 5, text_(lit("👤 Lavozim: "), "p_name")),
        F.when(v != 1, text_(lit("🏢 Kompaniya: "), "s_name")),
        F.when(v != 7, text_(lit("💰 Maosh: "), F.col("p_size").cast("string"), lit(f" 000 000 so{APOSTROPHE}m"))),
        F.when(v != 7, text_(F.when(v == 6, "Манзил: ").otherwise("📍 Manzil: "), "n_name")),
        F.when(v != 7, lit("⏰ Ish vaqti: 09:00 - 18:00")),
        F.when(v != 2, text_(lit("Telefon: +99890"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))),
        text_(lit("Murojaat: @hr_"), F.col("s_suppkey").cast("string")),
    )
    return rows.select(F.col("p_partkey").alias("k"), v.alias("v"), "p_name", "s_name", "n_name", "p_size", "s_suppkey", described.alias("description"))


def raw_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    return ads(spark, sf_dir).select(
        "k", F.lit("raw_post").alias("title"), null.alias("company"), "description", null.alias("salary"), null.alias("location"), F.lit("src_ads").alias("source"),
        F.concat(F.lit("https://t.me/src_ads/"), F.col("k").cast("string")).alias("url"), F.timestamp_seconds(F.lit(1704067200) + F.col("k") * 60).alias("posted_at"), F.array().cast("array<string>").alias("contact_links"),
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts: the first line is the title."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"), "source", F.concat(F.lit("https://t.me/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"))


_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query(f"""SELECT doc_id, sha256({_NORM.format('source')} || '|' || {_NORM.format("'https://t.me/' || source || '/' || doc_id")}) AS post_hash FROM documents""")
def source_post_hash(spark, sf_dir):
    d = raw_documents(spark, sf_dir)
    return d.select("doc_id", hashing.source_post_hash(F.col("source"), F.col("url")).alias("post_hash"))


@query(f"""SELECT doc_id, sha256(concat_ws('|', {_NORM.format('source')}, {_NORM.format("split_part(text, chr(10), 1)")}, '', '', '', {_NORM.format('lang')}, '', '', 'b ' || lang, '', '', array_to_string(list_sort([source, lang, 'm']), '|'), '', lang, {_NORM.format('text')})) AS content_hash FROM documents""")
def dedup_hash_full(spark, sf_dir):
    """The content hash of all documents, with details in some fields: texts are normalised, lists sorted."""
    d = raw_documents(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    details = {c: none for c in ("requirements", "responsibilities", "benefits", "additional", "work_schedule", "contact_text")} | {c: empty for c in ("contact_phone_numbers", "contact_telegram_usernames", "contact_links")}
    details |= {"requirements": F.concat(F.lit("  "), F.upper("lang")), "additional": F.concat(F.lit("B\t "), "lang"), "contact_phone_numbers": F.array("source", "lang", F.lit("m")), "contact_links": F.array("lang")}
    return d.select("doc_id", hashing.dedup_hash(F.col("title"), none, none, none, F.col("source"), F.col("url"), F.col("description"), details).alias("content_hash"))


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256({_NORM.format('text')}) ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1""")
def dedup_hash_latest(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_key(F.col("text")), 256).alias("h"))
    return dedup.dedup_latest(d, ["h"], [F.desc("doc_id")]).select("doc_id")


@query(f"""SELECT 'h' AS key, (count(*) - count(DISTINCT sha256({_NORM.format('text')})))::BIGINT AS deleted FROM documents""")
def delete_count(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_key(F.col("text")), 256).alias("h"))
    return dedup.duplicates(d, ["h"], [F.desc("doc_id")])


@query("""WITH e AS (SELECT event_id, user_id || ':' || event_type AS post, floor(value * 10)::BIGINT || ':' || event_type AS content FROM events),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post ORDER BY event_id DESC) AS r FROM e) WHERE r = 1)
SELECT event_id, post, content FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY event_id DESC) AS q FROM a) WHERE q = 1""")
def dedup_two_stage(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("post"), F.concat_ws(":", F.floor(F.col("value") * 10).cast("string"), "event_type").alias("content"))
    return dedup.dedup_latest(e, ["post", "content"], [F.desc("event_id")])


@query()
def on_conflict_insert(spark, sf_dir):
    """All orders inserted in order of their keys, with customer and day each unique. Tested against one insert after the other."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("h"), F.to_date("o_orderdate").alias("s"))
    return dedup.conflict_free_append(o, o.where("false"), ["h", "s"], ["id"])


@query()
def on_conflict_insert_all(spark, sf_dir):
    """All events inserted in order of id, with the keys of dedup_two_stage unique. Tested against one insert after the other."""
    e = read(spark, sf_dir, "events").select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("post"), F.concat_ws(":", F.floor(F.col("value") * 10).cast("string"), "event_type").alias("content"))
    return dedup.conflict_free_append(e, e.where("false"), ["post", "content"], ["event_id"])


@query("""SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
AND lower(trim(o_orderpriority)) NOT IN ('raw_post', 'placeholder') ORDER BY o_orderdate, o_orderkey LIMIT 25""")
def ready_for_publication(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("posted_at"), F.lit(0).alias("created_at"))
    posts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("channel_chat_id"))
    return publication.ready_for_publication(o, posts, "R", 25).select(F.col("id").alias("o_orderkey"), F.col("posted_at").alias("o_orderdate"), F.col("title").alias("o_orderpriority"))


@query("""SELECT c_custkey AS id, greatest(CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1996-01-01' END, m) AS telegram_published_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def latest_publish_merge(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("1996-01-01").cast("timestamp_ntz")).alias("telegram_published_at"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("published_at"))
    return publication.merge_latest_published(c, o)


@query("""SELECT id, job_id, channel_chat_id, published_at FROM (SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS job_id, l_returnflag AS channel_chat_id, l_shipdate AS published_at,
row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate, l_orderkey || '-' || l_linenumber) AS r FROM lineitem WHERE l_linenumber > 1)
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_linenumber = 1 AND x.l_orderkey = job_id AND x.l_returnflag = channel_chat_id)""")
def mark_published(spark, sf_dir):
    """The posts that are added: the first of each job and chat, unless it is there already."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("channel_chat_id"), F.col("l_shipdate").alias("published_at"))
    return publication.new_posts(li.where("n = 1").drop("n"), li.where("n > 1").drop("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return publication.cascade_delete(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("job_id")), c).select("o_orderkey", F.col("job_id").alias("o_custkey"))


@query("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey = 7")
def find_by_id(spark, sf_dir):
    return publication.find_by_id(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), 7)


_FORM = "replace(replace(replace(url_encode({}), '%20', '+'), '~', '%7E'), '%2A', '*')"


@query(f"""SELECT page_id, '/pages?' || concat_ws('&', 'url=' || {_FORM.format('url')}, 'a+%26+b=' || {_FORM.format("'t ' || page_id || ' ~*/ ў'")}, CASE WHEN page_id % 3 = 0 THEN 'n=' || page_id END) AS uri FROM pages""")
def page_query_strings(spark, sf_dir):
    """Links of pages, with their fields as a query string; a field without a value is left out."""
    fields = {"url": F.col("url"), "a & b": F.concat(F.lit("t "), F.col("page_id").cast("string"), F.lit(" ~*/ ў")), "n": F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string"))}
    params = F.create_map(*(y for name, value in fields.items() for y in (F.lit(name), value)))
    return read(spark, sf_dir, "pages").select("page_id", forms.with_query(F.lit("/pages"), params).alias("uri"))


@query("""SELECT event_id, '{"id":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"kind":"' || event_type || '"' ELSE '' END || ',"list":[' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '{"u":' || user_id || '},' END || '{}],"map":{' || CASE WHEN event_id % 5 = 0 THEN '' ELSE '"k":[' || event_id || ']' END || '}}' AS body FROM events""")
def event_json_bodies(spark, sf_dir):
    """Events as JSON without nulls at any depth: fields, elements of lists and values of maps."""
    unless = lambda n, x: F.when(F.col("event_id") % n != 0, x)
    user = F.struct(F.col("user_id").alias("u"))
    fields = {
        "id": F.col("event_id"), "kind": F.when(F.col("event_id") % 2 == 0, F.col("event_type")), "list": F.array(unless(3, user), F.struct(F.lit(None).cast("long").alias("u"))),
        "map": F.create_map(F.lit("k"), unless(5, F.array(F.lit(None).cast("long"), F.col("event_id"))), F.lit("none"), F.lit(None).cast("array<bigint>")),
    }
    rows = read(spark, sf_dir, "events").select("event_id", F.struct(*(x.alias(c) for c, x in fields.items())).alias("event"))
    return rows.select("event_id", forms.json_body(F.col("event"), rows.schema["event"].dataType).alias("body"))


@query("""SELECT doc_id, CASE WHEN source IS NULL THEN 0 ELSE 1 END + CASE WHEN lang IS NULL THEN 0 ELSE 1 END AS parts, CASE WHEN source IS NOT NULL THEN coalesce(text, '') END AS of_source, CASE WHEN lang IS NOT NULL THEN 'l' || doc_id END AS of_lang FROM documents""")
def document_text_parts(spark, sf_dir):
    """Documents as parts of a form that repeat a name or have none, as a map from name to text."""
    part = lambda name, value: F.struct(name.alias("name"), value.alias("text"))
    parts = F.array(part(F.col("source"), F.lit("first")), part(F.col("lang"), F.concat(F.lit("l"), F.col("doc_id").cast("string"))), part(F.lit(" "), F.lit("blank")), part(F.lit(None).cast("string"), F.lit("none")), part(F.col("source"), F.col("text")))
    made = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", forms.text_parts(parts).alias("made"))
    return made.select("doc_id", F.size("made").alias("parts"), F.try_element_at("made", "source").alias("of_source"), F.try_element_at("made", "lang").alias("of_lang"))


def clustered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table of jobs that is clustered by time and place, written and read back."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("place "), (F.col("o_custkey") % 40).cast("string")).alias("location"), F.col("o_orderdate").alias("posted_at"), F.lit(0).alias("created_at"))
    path = f"{dedup.scratch_dir(spark)}/clustered-{uuid.uuid4().hex}"
    tables.write_clustered(o, path)
    return spark.read.schema(o.schema).parquet(path)


@query("""SELECT o_orderkey::VARCHAR AS id, o_orderdate AS posted_at FROM orders WHERE o_custkey % 40 = 7 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'""")
def jobs_by_location(spark, sf_dir):
    """The jobs of a place within a time, from the clustered table."""
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01", "1996-07-01"))
    return tables.by_location(clustered_orders(spark, sf_dir), "place 7", since, until).select("id", "posted_at")


@query("""SELECT o_orderkey::VARCHAR AS id, o_orderdate AS posted_at, o_orderpriority AS title FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') ORDER BY o_orderdate, o_orderkey::VARCHAR LIMIT 25""")
def ready_from_clustered(spark, sf_dir):
    """The oldest unpublished jobs, chosen by narrow columns of the clustered table and then read whole."""
    posts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("job_id"), F.col("l_returnflag").alias("channel_chat_id"))
    return tables.ready_from_clustered(clustered_orders(spark, sf_dir), posts, "R", 25).select("id", "posted_at", "title")


@query("""WITH j AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN replace(props, '"k"', '"x"') WHEN 2 THEN '{"k": "' || event_type || '", "name": 5}' WHEN 3 THEN '{"k": null, "name": "' || event_type || '"}' WHEN 4 THEN 'oops ' || event_type ELSE replace(props, '}', '.5}') END AS j FROM events),
t AS (SELECT *, json_valid(j) AS fine, CASE WHEN json_valid(j) THEN json_type(j, '$.k') END AS k, CASE WHEN json_valid(j) THEN json_type(j, '$.name') END AS n FROM j),
p AS (SELECT *, CASE WHEN NOT fine THEN '=no JSON object' ELSE concat_ws('; ', CASE WHEN k IS NULL THEN 'k=missing' WHEN k = 'NULL' THEN 'k=null' WHEN k NOT IN ('BIGINT', 'UBIGINT') THEN 'k=expected bigint' END, CASE WHEN n NOT IN ('VARCHAR', 'NULL') THEN 'name=expected string' END) END AS problems FROM t)
SELECT event_id, problems, CASE WHEN problems = '' THEN json_extract(j, '$.k')::BIGINT END AS k FROM p""")
def decode_all_faults(spark, sf_dir):
    """Properties of events, some damaged, decoded with every fault of every field."""
    v, e = F.col("event_id") % 6, F.col("event_type")
    j = (
        F.when(v == 0, F.col("props")).when(v == 1, F.replace("props", F.lit('"k"'), F.lit('"x"'))).when(v == 2, F.concat(F.lit('{"k": "'), e, F.lit('", "name": 5}'))).when(v == 3, F.concat(F.lit('{"k": null, "name": "'), e, F.lit('"}')))
        .when(v == 4, F.concat(F.lit("oops "), e)).otherwise(F.replace("props", F.lit("}"), F.lit(".5}")))
    )
    schema = StructType([StructField("k", LongType()), StructField("name", StringType())])
    d = read(spark, sf_dir, "events").select("event_id", decode_accumulating(j, schema, ("k",)).alias("x"))
    said = F.array_join(F.transform("x.problems", lambda p: F.concat(p.field, F.lit("="), p.problem)), "; ")
    return d.select("event_id", said.alias("problems"), "x.value.k")


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def norm_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize_key(F.col("text")).alias("norm"))


@query("SELECT p_partkey, upper(substr(trim(p_name), 1, 1)) || substr(trim(p_name), 2) AS title FROM part")
def sentence_case(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.sentence_case(F.col("p_name")).alias("title"))


@query(f"""WITH {ADS_SQL} SELECT k, i::INT AS i, trim(regexp_replace(replace(l, '{APOSTROPHE}', chr(39)), '^[\\s👤🏢💰📍⏰]+', '')) AS line
FROM (SELECT k, unnest(string_split(description, chr(10))) AS l, unnest(range(len(string_split(description, chr(10))))) AS i FROM ads)""")
def strip_decorations(spark, sf_dir):
    a = ads(spark, sf_dir).select("k", F.posexplode(F.transform(lines.split_lines(F.col("description")), text.strip_decorations)).alias("i", "line"))
    return a


@query(f"""WITH {ADS_SQL} SELECT k, concat_ws(',', CASE WHEN v <> 1 THEN split_part(s_name, '#', 2) END, CASE WHEN v <> 7 THEN p_size || '000000' END, CASE WHEN v <> 2 THEN '+99890' || lpad(k::VARCHAR, 7, '0') END) AS phones, 'hr_' || s_suppkey AS names FROM ads""")
def extract_contacts(spark, sf_dir):
    """Phones and names of whole posts: an amount or a name with seven digits or more is a number like any other."""
    a = ads(spark, sf_dir)
    return a.select("k", F.array_join(contacts.phones(F.col("description")), ",").alias("phones"), F.array_join(contacts.usernames(F.col("description"), F.array(F.lit("src_ads"))), ",").alias("names"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\+?998(?:[\\s\\-()]?\\d){9}'), lambda x: '+' || regexp_replace(x, '\\D', '', 'g')))), ',') AS phones FROM documents""")
def extract_uzbek_phones(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(contacts.uzbek_phones(F.col("text"))), ",").alias("phones"))


@query("""SELECT page_id, CASE WHEN u LIKE 'http://%' OR u LIKE 'https://%' THEN u END AS link FROM (SELECT page_id, regexp_replace(trim(url), '[.,;:!?]+$', '') AS u FROM pages)""")
def normalize_link(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", contacts.normalize_link(F.col("url")).alias("link"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://t.me/' || source || '/' || doc_id WHEN doc_id % 3 = 1 THEN 'https://t.me/c/' || (1000 + doc_id) || '/' || doc_id ELSE 'https://t.me/c/' || (doc_id + 5) || '/' || doc_id END AS url,
CASE WHEN doc_id % 3 = 0 THEN source WHEN false THEN '' ELSE NULL END AS handle FROM documents""")
def message_url(spark, sf_dir):
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents")
    chat = F.when(k % 3 == 1, F.concat(F.lit("-100"), (k + 1000).cast("string")).cast("long")).otherwise(k + 5)
    url = text.message_url(F.when(k % 3 == 0, F.col("source")), chat, k)
    return d.select("doc_id", url.alias("url"), F.when(k % 3 == 0, contacts.source_handle(url)).alias("handle"))


@query("""SELECT doc_id, i::INT AS i, l AS line FROM (SELECT doc_id, unnest(x) AS l, unnest(range(len(x))) AS i FROM
(SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(replace(l, '`', chr(39)), '[ \\t\\r\\f]+', ' ', 'g'))), lambda l: l <> '') AS x FROM documents))""")
def line_split_explode(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines.split_lines(F.col("text"))).alias("i", "line"))


_LINES_SQL = "list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(replace(l, '`', chr(39)), '[ \\t\\r\\f]+', ' ', 'g'))), lambda l: l <> '')"


@query(f"""SELECT doc_id, array_to_string(list_filter(x, lambda l, i: list_position(x, l) = i), chr(10)) AS text FROM (SELECT doc_id, {_LINES_SQL} AS x FROM documents)""")
def ordered_distinct_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(lines.ordered_distinct(lines.split_lines(F.col("text"))), "\n").alias("text"))


@query(f"""SELECT doc_id, array_to_string(list_filter(x, lambda l: NOT list_contains(x[1:2], l)), chr(10)) AS rest FROM (SELECT doc_id, {_LINES_SQL} AS x FROM documents)""")
def subtract_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", lines.split_lines(F.col("text")).alias("x")).select("doc_id", F.array_join(lines.subtract_lines(F.col("x"), F.slice("x", 1, 2), lambda y: y), "\n").alias("rest"))


@query(f"""SELECT doc_id, array_to_string(CASE WHEN p IS NULL OR p = 0 THEN x ELSE x[1:p-1] END, chr(10)) AS head FROM (SELECT doc_id, x, list_position(list_transform(x, lambda l: length(l) < 40), true) AS p FROM (SELECT doc_id, {_LINES_SQL} AS x FROM documents))""")
def take_until_boundary(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", lines.split_lines(F.col("text")).alias("x")).select("doc_id", F.array_join(lines.take_until(F.col("x"), lambda y: F.length(y) < 40), "\n").alias("head"))


@query(f"""SELECT doc_id, CASE WHEN len(f) = 0 THEN '' ELSE array_to_string(x[list_min(f):list_max(f)], chr(10)) END AS kept FROM (SELECT doc_id, x, list_filter(list_transform(x, lambda l, i: CASE WHEN length(l) >= 40 THEN i END), lambda i: i IS NOT NULL) AS f FROM (SELECT doc_id, {_LINES_SQL} AS x FROM documents))""")
def trim_edges(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", lines.split_lines(F.col("text")).alias("x")).select("doc_id", F.array_join(lines.trim_edges(F.col("x"), lambda y: F.length(y) < 40), "\n").alias("kept"))


@query("""SELECT conv_id, island::INT AS island, any_value(role) AS role, count(*) AS turns FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations) WHERE island > 0 AND role = 'user' GROUP BY conv_id, island""")
def section_islands(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    c = read(spark, sf_dir, "conversations").withColumn("island", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).cast("int"))
    return c.where("island > 0 and role = 'user'").groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.count("*").alias("turns"))


@query(f"""WITH {ADS_SQL} SELECT k, (CASE WHEN v = 1 THEN 0 ELSE 1 END + CASE WHEN v = 7 THEN 0 ELSE 3 END + CASE WHEN v = 2 THEN 0 ELSE 1 END + 1)::INT AS labels FROM ads""")
def label_gate(spark, sf_dir):
    a = ads(spark, sf_dir).select("k", F.transform(lines.split_lines(F.col("description")), detect_label).alias("x"))
    return a.select("k", F.size(F.array_distinct(F.filter(F.transform("x", lambda y: y.kind), lambda y: y.isNotNull() & (y != "title")))).alias("labels"))


_REASON = "CASE v WHEN 7 THEN 'company_phone_only' WHEN 1 THEN 'missing_company' WHEN 2 THEN 'missing_phone' WHEN 3 THEN 'multiple_roles_detected' WHEN 4 THEN 'multiple_roles_detected' WHEN 5 THEN 'missing_title' END"


@query(f"""WITH {ADS_SQL} SELECT k, CASE WHEN v = 7 THEN 'too_few_optional_fields' ELSE {_REASON} END AS reason, v IN (0, 6) AS ok,
CASE WHEN v IN (0, 6) THEN p_name END AS title, CASE WHEN v IN (0, 6) THEN s_name END AS company, CASE WHEN v IN (0, 6) THEN p_size || ' 000 000 so''m' END AS salary, CASE WHEN v IN (0, 6) THEN n_name END AS location,
CASE WHEN v IN (0, 6) THEN '+99890' || lpad(k::VARCHAR, 7, '0') END AS phones, CASE WHEN v IN (0, 6) THEN 'hr_' || s_suppkey END AS names, CASE WHEN v IN (0, 6) THEN '09:00 - 18:00' END AS work_schedule FROM ads""")
def parse_structured_ads(spark, sf_dir):
    p = parse_structured(raw_ads(spark, sf_dir))
    return p.select("k", "reason", "ok", F.col("parsed_title").alias("title"), F.col("parsed_company").alias("company"), F.col("parsed_salary").alias("salary"), F.col("parsed_location").alias("location"), F.array_join("contact_phone_numbers", ",").alias("phones"), F.array_join("contact_telegram_usernames", ",").alias("names"), "work_schedule")


@query(f"""WITH {ADS_SQL} SELECT coalesce(CASE WHEN v = 7 THEN 'too_few_optional_fields' ELSE {_REASON} END, 'parsed') AS reason, count(*) AS n FROM ads GROUP BY ALL""")
def reject_reason_counts(spark, sf_dir):
    return parse_structured(raw_ads(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("parsed")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {ADS_SQL} SELECT k, v <> 7 AS ok, CASE WHEN v = 7 THEN 'missing_structured_labels' END AS reason, CASE WHEN v IN (3, 4, 5) THEN 'raw_post' WHEN v <> 7 THEN p_name END AS title,
CASE WHEN v <> 7 THEN p_size || ' 000 000 so{APOSTROPHE}m' END AS salary, CASE WHEN v <> 7 THEN n_name END AS location FROM ads""")
def parse_field_only_ads(spark, sf_dir):
    marked = F.filter(lines.split_lines(F.col("description")), lambda x: F.contains(x, F.lit(":00")))
    rule = {"work_schedule": F.get(marked, F.lit(0)), "contact_telegram_usernames": contacts.usernames(F.col("description"), F.array(F.lit("src_ads")))}
    p = parse_field_only(with_details(raw_ads(spark, sf_dir), {"src_ads": rule}))
    return p.select("k", "ok", "reason", F.col("parsed_title").alias("title"), F.col("parsed_salary").alias("salary"), F.col("parsed_location").alias("location"))


@query("""SELECT p_partkey, (p_name LIKE '%/%' OR p_name LIKE '%,%' OR p_partkey % 2 = 0) AS several FROM part""")
def multi_role(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", is_multi_role(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" va "), "p_brand")).otherwise(F.col("p_name"))).alias("several"))


@query("""SELECT doc_id, lower(trim(t)) NOT IN ('raw_post', 'placeholder') AS stored, trim(t) <> '' AND lower(trim(t)) NOT IN ('raw_post', 'placeholder') AS eligible
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Raw_Post ' WHEN 1 THEN 'placeholder' WHEN 2 THEN '  ' ELSE source END AS t FROM documents)""")
def eligible_titles(spark, sf_dir):
    k = F.col("doc_id") % 4
    t = F.when(k == 0, " Raw_Post ").when(k == 1, "placeholder").when(k == 2, "  ").otherwise(F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", publication.title_is_stored_ok(t).alias("stored"), publication.title_is_eligible(t).alias("eligible"))


@query("""SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, text AS plain FROM documents""")
def escape_html(spark, sf_dir):
    c = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", text.escape_html(c).alias("escaped"), text.strip_html(text.escape_html(c)).alias("plain"))


@query("""SELECT count(*) AS total, count(*) FILTER (lang <> 'en') AS parsed_messages, count(*) FILTER (lang <> 'en') AS parsed_jobs, count(*) FILTER (lang = 'fr') AS missing_salary, 0::BIGINT AS missing_location,
coalesce(round(100.0 * count(*) FILTER (lang <> 'en') / nullif(count(*), 0), 2), 0.0)::DOUBLE AS success_rate FROM documents""")
def coverage_report(spark, sf_dir):
    job = F.struct(F.when(F.col("lang") != "fr", F.col("lang")).alias("salary"), F.col("source").alias("location"))
    d = read(spark, sf_dir, "documents").select(F.when(F.col("lang") != "en", F.array(job)).otherwise(F.array().cast("array<struct<salary:string,location:string>>")).alias("jobs"))
    return jobs.coverage_report(d)


@query("""SELECT 'https://t.me/' || source || '/' || doc_id AS url, source, CASE WHEN source IN ('src1', 'src2') THEN 'by ' || source ELSE 'raw_post' END AS title, length(trim(text)) AS n FROM documents WHERE trim(text) <> ''""")
def plugin_dispatch(spark, sf_dir):
    """All documents as messages of all their channels through the registry: two sources have a rule, the others pass as they are."""
    channels = [r.source for r in read(spark, sf_dir, "documents").select("source").where("source is not null").distinct().collect()]
    registry = jobs.Registry()
    for name in channels:
        rule = (lambda df: jobs.raw_passthrough(df).withColumn("title", F.concat(F.lit("by "), "source"))) if name in ("src1", "src2") else None
        registry.register(f"plugin_{name}", name, name, rule)
    registry.register("z_late", channels[0] if channels else "none", "never")
    registry.register("a_off", "src4", "never", enabled=False)
    d = raw_documents(spark, sf_dir)
    now = F.lit("2024-01-01").cast("timestamp")
    messages = d.select(F.col("doc_id").alias("id"), now.alias("date"), F.col("description").alias("text"), "url", F.array().cast("array<string>").alias("contact_links"), F.lit(0).cast("bigint").alias("views"), F.lit(0).cast("bigint").alias("forwards"), F.col("source").alias("channel"))
    return registry.ingest(messages).select("url", "source", "title", F.length("description").alias("n"))


def channel_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a channel: one job, a job for each role heading, a list of roles in one job, and no vacancy."""
    v, firm = F.col("p_partkey") % 4, _text("Firma", "$s_suppkey")
    one = _text(firm, " firmasiga ", "$p_name", " ishga taklif qilinadi\nTalablar:\nOylik: ", "$p_size", " mln\nManzil: ", "$n_name")
    headings = _text(firm, " firmasiga quyidagi lavozimlarga ishga taklif qilinadi\n", "$p_name", " sotuvchi\nTalablar:\nHalol\nOylik ", "$p_size", " mln\nKassir\nTalablar:\nOylik 4 mln\nManzil: ", "$n_name")
    listed = _text("Xodimlar kerak\n• ", "$p_name", "\n• Farrosh\nManzil: ", "$n_name", "\nMaosh kelishiladi")
    told = F.when(v == 0, one).when(v == 1, headings).when(v == 2, listed).otherwise("Yangiliklar")
    posts = posts_of(spark, sf_dir, "vacancies", F.lit(""), told)
    return posts.select(F.col("k").alias("id"), F.col("posted_at").alias("date"), F.concat(F.lit("#ish\n"), "description").alias("text"), "url", "contact_links", F.lit("vacancies").alias("channel"))


def channel_jobs(messages: DataFrame) -> DataFrame:
    registry = jobs.Registry()
    registry.register("vacancies", "vacancies", "vacancies", channel_posts.vacancies)
    return registry.ingest(messages)


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS v, p_name, p_size, n_name, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = s_nationkey)
SELECT 'https://t.me/vacancies/' || k AS url, p_name AS title, {_FIRM} || ' firmasi' AS company, p_size || ' mln' AS salary, n_name AS location FROM p WHERE v = 0
UNION ALL SELECT 'https://t.me/vacancies/' || k || '#role-1', p_name || ' sotuvchi', {_FIRM} || ' firmasi', p_size || ' mln', n_name FROM p WHERE v = 1
UNION ALL SELECT 'https://t.me/vacancies/' || k || '#role-2', 'Kassir', {_FIRM} || ' firmasi', '4 mln', n_name FROM p WHERE v = 1
UNION ALL SELECT 'https://t.me/vacancies/' || k, p_name || ' / Farrosh', NULL, 'kelishiladi', n_name FROM p WHERE v = 2""")
def channel_vacancies(spark, sf_dir):
    """Messages of a channel by its rule."""
    return channel_jobs(channel_messages(spark, sf_dir)).select("url", "title", "company", "salary", "location")


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS v, p_name, p_size, n_name, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = s_nationkey)
SELECT 'https://t.me/vacancies/' || k AS url, CASE v WHEN 0 THEN p_name WHEN 1 THEN p_name || ' sotuvchi / Kassir' ELSE p_name || ' / Farrosh' END AS title, CASE WHEN v < 2 THEN {_FIRM} || ' firmasi' END AS company,
 CASE WHEN v < 2 THEN p_size || ' mln' ELSE 'kelishiladi' END AS salary, n_name AS location FROM p WHERE v < 3""")
def channel_single_vacancies(spark, sf_dir):
    """Messages of a channel by its rule, one job for each: a list of roles is named in the title."""
    registry = jobs.Registry()
    registry.register("vacancies", "vacancies", "vacancies", lambda messages: channel_posts.vacancies(messages, split=False))
    return registry.ingest(channel_messages(spark, sf_dir)).select("url", "title", "company", "salary", "location")


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS v, p_name, p_size, n_name, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = s_nationkey)
SELECT 'https://t.me/notices/' || k AS url, CASE v WHEN 0 THEN p_name WHEN 1 THEN p_name || ' kassir / Oshpaz' ELSE {_FIRM} || ' kafesiga oshpaz kerak' END AS title, CASE v WHEN 2 THEN {_FIRM} || ' kafe' ELSE {_FIRM} END AS company,
 CASE WHEN v <> 2 THEN p_size || ' mln' END AS salary, CASE WHEN v <> 2 THEN n_name END AS location FROM p WHERE v < 3""")
def notice_vacancies(spark, sf_dir):
    """Messages of a channel of notices by its rule: labelled, with a list of roles, an invitation alone, and an advertisement."""
    v, firm = F.col("p_partkey") % 4, _text("Firma", "$s_suppkey")
    facts = _text("\nManzil: ", "$n_name", "\nMaosh: ", "$p_size", " mln")
    told = (
        F.when(v == 0, _text("YANGI ISH\nIsh lavozimi: ", "$p_name", "\nIsh beruvchi: ", firm, facts)).when(v == 1, _text("Bo'sh ish o'rinlari:\n• ", "$p_name", " kassir\n• Oshpaz\nIsh beruvchi: ", firm, facts))
        .when(v == 2, _text(firm, " kafesiga oshpaz kerak")).otherwise("#reklama\nOshpaz kerak")
    )
    posts = posts_of(spark, sf_dir, "notices", F.lit(""), told)
    messages = posts.select(F.col("k").alias("id"), F.col("posted_at").alias("date"), F.col("description").alias("text"), "url", "contact_links", F.lit("notices").alias("channel"))
    registry = jobs.Registry()
    registry.register("notices", "notices", "notices", listing_posts.notices)
    return registry.ingest(messages).select("url", "title", "company", "salary", "location")


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS v, p_name, p_size, n_name, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = s_nationkey)
SELECT 'https://t.me/city/' || k AS url, CASE v WHEN 0 THEN p_name || ' kassir' ELSE 'Kuryer' END AS title, CASE v WHEN 0 THEN {_FIRM} || ' kompaniyasi' END AS company, p_size || ' mln' AS salary,
 CASE v WHEN 0 THEN n_name || '; metro yonida' ELSE 'Ish hududni o''zingiz tanlaysiz' END AS location FROM p WHERE v < 2""")
def city_vacancies(spark, sf_dir):
    """Messages of a city's channel by its variant of the notices' rule: places of several lines, own labels and phrases."""
    v, firm = F.col("p_partkey") % 3, _text("Firma", "$s_suppkey")
    told = (
        F.when(v == 0, _text("✅ ", firm, " kompaniyasiga ", "$p_name", " kassir ishga taklif qilinadi\nManzil: ", "$n_name", "\nmetro yonida\nDaromad: ", "$p_size", " mln"))
        .when(v == 1, _text("Kuryer kerak\nIsh hududni o‘zingiz tanlaysiz!\nTo`lov: ", "$p_size", " mln")).otherwise("Kuryer kerak, online daromad")
    )
    posts = posts_of(spark, sf_dir, "city", F.lit(""), told)
    messages = posts.select(F.col("k").alias("id"), F.col("posted_at").alias("date"), F.col("description").alias("text"), "url", "contact_links", F.lit("city").alias("channel"))
    registry = jobs.Registry()
    registry.register("city", "city", "city", lambda df: listing_posts.notices(df, listing_posts.CITIES["ishbor_toshkent_kerak_ishchi_bor"]))
    return registry.ingest(messages).select("url", "title", "company", "salary", "location")


def emoji_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages with entities: a hidden link, a marked part of the text behind emoji, the channel's own link, and no link."""
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("\n  😀👍🏽 Ariza https://a.example/"), k, F.lit("x\n"))
    mark = lambda kind, at, n, url: F.struct(F.lit(kind).alias("type"), F.lit(at).alias("offset"), (n if not isinstance(n, int) else F.lit(n)).cast("int").alias("length"), url.alias("url"))
    none = F.lit(None).cast("string")
    marks = F.array(mark("text_url", 0, 1, F.concat(F.lit("https://forms.example/"), k, F.lit("."))), mark("url", 10, F.length(k) + 18, none), mark("text_url", 4, 5, F.concat(F.lit("t.me/"), "source")), mark("bold", 0, 3, F.lit("https://no.example")))
    d = read(spark, sf_dir, "documents").where("source is not null")
    return d.select(F.col("doc_id").alias("id"), F.lit("2024-01-01").cast("timestamp").alias("date"), text.alias("text"), F.concat(F.lit("https://t.me/"), "source", F.lit("/"), k).alias("url"), F.array(F.concat(F.lit("https://given.example/"), k)).alias("contact_links"), F.col("source").alias("channel"), marks.alias("entities"))


@query("""SELECT doc_id AS id, 'https://given.example/' || doc_id || ' https://forms.example/' || doc_id || ' https://a.example/' || doc_id || ' https://a.example/' || doc_id || 'x' AS links FROM documents WHERE source IS NOT NULL""")
def entity_links(spark, sf_dir):
    """The links of messages: exported, then of entities (offsets count characters behind emoji), then visible ones."""
    messages = emoji_messages(spark, sf_dir).withColumn("source", F.col("channel"))
    return messages.select("id", F.array_join(contacts.links_of(messages), " ").alias("links"))


@query("""SELECT source, count(*) FILTER (source <> 'src2') AS jobs, count(*) FILTER (source = 'src2') AS dead FROM documents WHERE source IS NOT NULL GROUP BY source""")
def dispatch_outcomes(spark, sf_dir):
    """Messages of all channels through rules of which one is broken: it costs its own messages, which are dead letters."""

    def broken(df):
        raise ValueError("a broken rule")

    registry = jobs.Registry()
    for i in range(64):
        registry.register(f"plugin_{i:02}", f"src{i}", f"src{i}", broken if i == 2 else jobs.raw_passthrough if i in (1, 3) else None)
    raw, dead = registry.dispatch(emoji_messages(spark, sf_dir))
    both = raw.select("source", F.lit(1).alias("j"), F.lit(0).alias("d")).unionByName(dead.select(F.col("channel").alias("source"), F.lit(0).alias("j"), F.lit(1).alias("d")))
    return both.groupBy("source").agg(F.sum("j").alias("jobs"), F.sum("d").alias("dead"))


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 2 AS v, p_name, p_size, n_name, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = s_nationkey)
SELECT 'https://t.me/signs/' || k AS url, p_name || ' kassir / Oshpaz ( ayol )' AS title, {_FIRM} AS company, p_size || ' mln' AS salary, n_name || ' (bozor)' AS location FROM p WHERE v = 0
UNION ALL SELECT 'https://t.me/city_signs/' || k, 'kuryer', {_FIRM} || ' Trading kompaniyasi', p_size || ' mln', n_name || ' shahar, metro' FROM p WHERE v = 1""")
def channel_signs(spark, sf_dir):
    """Notices with joined emoji before and behind words, and posts of a city's channel with signs and dashes that no list names."""
    v, firm = F.col("p_partkey") % 2, _text("Firma", "$s_suppkey")
    joined = _text("💁🏻‍♂ Bo'sh ish o'rinlari ⬇\n1. ", "$p_name", " kassir 👨🏻‍💻\n2. Oshpaz ( ayol ) 👷🏻‍♂\n👩‍💼 Ish beruvchi: ", firm, "\n💰 Oylik: ", "$p_size", " mln\n❤️‍🔥 Manzil: ", "$n_name", "\n🏳️‍🌈 Mo'ljal: bozor")
    city = _text("⚡️ ", firm, " Trading kompaniyasiga kuryer kerak\n💵 Maosh: ", "$p_size", " mln\n📍 Hudud: Toshkent\n⏰ Ish vaqti:\n– 09:00 dan\n📌 Manzil:\n– ", "$n_name", " shahar, metro\n☎️ Bog‘lanish:\n– +998901234567")
    registry = jobs.Registry()
    registry.register("signs", "signs", "signs", listing_posts.notices)
    registry.register("city_signs", "city_signs", "city_signs", lambda df: listing_posts.notices(df, listing_posts.CITIES["ishchi_bor_kerak_toshkent"]))
    posts = posts_of(spark, sf_dir, "signs", v, F.when(v == 0, joined).otherwise(city)).withColumn("channel", F.when(F.col("title") == 0, "signs").otherwise("city_signs"))
    messages = posts.select(F.col("k").alias("id"), F.col("posted_at").alias("date"), F.col("description").alias("text"), F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), F.col("k").cast("string")).alias("url"), "contact_links", "channel")
    return registry.ingest(messages).select("url", "title", "company", "salary", "location")


@query("""SELECT doc_id AS id, text, 'https://t.me/' || source || '/' || doc_id AS url, source AS channel FROM documents ORDER BY doc_id DESC LIMIT 250""")
def export_newest(spark, sf_dir):
    """The newest messages of an export of all documents, read by pages from the newest on."""
    path = f"{dedup.scratch_dir(spark)}/export-{uuid.uuid4().hex}"
    channel_source.write_export(raw_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("description").alias("text"), "url", F.col("source").alias("channel")), path, 200)
    return channel_source.read_export(spark, path, 250).select("id", "text", "url", "channel")


@query("""SELECT count(*) AS read, (count(*) FILTER (p_partkey % 4 IN (0, 2)) + 2 * count(*) FILTER (p_partkey % 4 = 1))::BIGINT AS published, count(*) FILTER (p_partkey % 4 = 3) AS skipped FROM part""")
def replay_counts(spark, sf_dir):
    """How many messages of the channel were read, skipped, and how many jobs came of them."""
    messages = channel_messages(spark, sf_dir)
    return jobs.replay_report(jobs.by_message(messages, channel_jobs(messages)))


@query("""SELECT kind, id, sample FROM (
(SELECT 'failure' AS kind, p_partkey AS id, '#ish' || chr(10) || 'Yangiliklar' AS sample FROM part WHERE p_partkey % 4 = 3 ORDER BY p_partkey LIMIT 20)
UNION ALL (SELECT 'example', id, sample FROM (SELECT p_partkey AS id, i, CASE WHEN p_partkey % 4 = 1 AND i = 1 THEN 'Kassir' WHEN p_partkey % 4 = 1 THEN p_name || ' sotuvchi' WHEN p_partkey % 4 = 2 THEN p_name || ' / Farrosh' ELSE p_name END AS sample
 FROM part, (VALUES (1), (2)) t(i) WHERE p_partkey % 4 IN (0, 1, 2) AND (i = 1 OR p_partkey % 4 = 1)) ORDER BY id, i LIMIT 5))""")
def coverage_samples(spark, sf_dir):
    """The first messages without a job, and the titles of the first jobs."""
    messages = channel_messages(spark, sf_dir)
    found = jobs.coverage_samples(jobs.by_message(messages, channel_jobs(messages)))
    return found.select("kind", "id", F.when(F.col("kind") == "example", F.get_json_object("sample", "$.title")).otherwise(F.col("sample")).alias("sample"))


@query("""SELECT doc_id, ok, CASE WHEN ok THEN 'https://t.me/' || source || '/' || doc_id END AS url, CASE WHEN ok THEN split_part(text, chr(10), 1) END AS title, CASE WHEN ok THEN text END AS description, CASE WHEN ok THEN source END AS source,
CASE WHEN ok THEN 'l1,' || doc_id END AS links FROM (SELECT *, split_part(text, chr(10), 1) <> '' AND text <> '' AS ok FROM documents)""")
def json_roundtrip(spark, sf_dir):
    """All fields of raw jobs after encoding and decoding; a job without a required field is not decoded."""
    d = raw_documents(spark, sf_dir).withColumn("posted_at", F.lit("2024-01-01").cast("timestamp")).withColumn("company", F.lit(None).cast("string"))
    d = d.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("title", "description")} | {"contact_links": F.array(F.lit("l1"), F.col("doc_id").cast("string"))})
    value = F.to_json(F.struct("title", "company", "description", "source", "url", "posted_at", "contact_links"))
    back = d.select("doc_id", decode_raw(value).alias("job"))
    return back.select("doc_id", F.col("job").isNotNull().alias("ok"), "job.url", "job.title", "job.description", "job.source", F.when(F.col("job").isNotNull(), F.array_join("job.contact_links", ",")).alias("links"))


@query(f"""WITH {ADS_SQL} SELECT 'https://t.me/src_ads/' || k AS source_url, '🔥 <b>' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || '</b>' || chr(10) || chr(10)
 || CASE v WHEN 6 THEN '🏢 <b>Компания:</b> ' ELSE '🏢 <b>Kompaniya:</b> ' END || s_name || chr(10) || CASE v WHEN 6 THEN '💸 <b>Маош:</b> ' ELSE '💸 <b>Maosh:</b> ' END || p_size || ' 000 000 so''m' || chr(10)
 || CASE v WHEN 6 THEN '📍 <b>Манзил:</b> ' ELSE '📍 <b>Manzil:</b> ' END || n_name || chr(10) || CASE v WHEN 6 THEN '🕒 <b>Иш вақти:</b> ' ELSE '🕒 <b>Ish vaqti:</b> ' END || '09:00 - 18:00' || chr(10) || chr(10)
 || '💬 <b>Telegram:</b>' || chr(10) || '• @hr_' || s_suppkey || chr(10) || chr(10) || CASE v WHEN 6 THEN '☎️ <b>Телефон:</b>' ELSE '☎️ <b>Telefon:</b>' END || chr(10) || '• +99890' || lpad(k::VARCHAR, 7, '0') || chr(10) || chr(10) || '@ads_channel' AS caption
FROM ads WHERE v IN (0, 6)""")
def caption_render(spark, sf_dir):
    """Captions of the parsed ads, labelled in the script of the post; no caption is longer than the limit."""
    table = jobs.parsed_jobs(raw_ads(spark, sf_dir), F.lit("2024-01-01").cast("timestamp"))
    return table.select("source_url", caption.render("ads_channel").alias("caption"))


@query(f"""WITH {ADS_SQL} SELECT 'https://t.me/src_ads/' || k AS source_url, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title, s_name AS company FROM ads WHERE v IN (0, 6)""")
def ingest_jobs(spark, sf_dir):
    table = jobs.parsed_jobs(raw_ads(spark, sf_dir), F.lit("2024-01-01").cast("timestamp"))
    new = dedup.conflict_free_append(table, table.where("false"), ["id", "dedup_hash", "source_post_hash"], ["posted_at", "source_url"])
    return new.select("source_url", "title", "company")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 2 AS v, '🔥 <b>Job &amp; ' || p_name || '</b>' || chr(10) || chr(10) || '💸 <b>Maosh:</b> ' || p_size || ' mln' || chr(10) || chr(10) || '📋 <b>Talablar:</b>' || chr(10) AS head,
 (1018 - (9 + length(p_name)) - 2 - (10 + length(p_size || ' mln')) - 2 - 12) // 13 AS n FROM part)
SELECT k, head || array_to_string(list_transform(range(1, n + 1), lambda i: '• Talab ' || lpad(i::VARCHAR, 4, '0')), chr(10)) || chr(10) || chr(10) || '@ads' AS caption FROM p WHERE v = 0
UNION ALL SELECT k, head || '• Talab bir' || chr(10) || '• Talab ikki' || chr(10) || chr(10) || '🎁 <b>Qulayliklar:</b>' || chr(10) || '• Bepul tushlik' || chr(10) || chr(10) || '✨ <b>Qo''shimcha:</b>' || chr(10) || '• Eslatma &lt;muhim&gt;' || chr(10) || chr(10)
 || '📨 <b>Murojaat:</b>' || chr(10) || '• Soat 9 dan' || chr(10) || chr(10) || '🔗 <b>Havolalar:</b>' || chr(10) || '• <a href="https://x.example/?a=1&amp;b=&quot;' || k || '&quot;">Murojaat 1</a>' || chr(10) || chr(10) || '☎️ <b>Telefon:</b>' || chr(10) || '• +99890' || lpad(k::VARCHAR, 7, '0') || chr(10) || chr(10) || '@ads' FROM p WHERE v = 1""")
def caption_blocks(spark, sf_dir):
    """Captions that reach the limit (the list is cut after the last line that fits, and nothing more does) and captions with
    all blocks: links, lines that repeat a phone, labels and calls that go."""
    k, v = F.col("p_partkey").cast("string"), F.col("p_partkey") % 2
    phone = F.concat(F.lit("+99890"), F.lpad(k, 7, "0"))
    many = "\n".join(f"Talab {i:04}" for i in range(1, 101))
    short = lambda *x: F.when(v == 1, F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x)))
    values = {
        "title": _text("Job & ", "$p_name"), "salary": _text("$p_size", " mln"), "requirements": F.when(v == 0, many).otherwise("Talab bir\n• Talab ikki"), "benefits": short("Bepul tushlik\n", phone, "\nRezyume yuboring"),
        "additional": short("Eslatma <muhim>\nOylik 5 mln\nManzil: X"), "contact_text": short("Murojaat uchun\n", phone, "\nSoat 9 dan"), "contact_phone_numbers": F.array(phone), "contact_links": F.array(F.concat(F.lit('https://x.example/?a=1&b="'), k, F.lit('"'))),
        "contact_telegram_usernames": F.array().cast("array<string>"),
    }
    rest = ["description", "company", "location", "responsibilities", "work_schedule"]
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *(x.alias(c) for c, x in values.items()), *(F.lit(None).cast("string").alias(c) for c in rest))
    return rows.select("k", caption.render("ads").alias("caption"))


_TEL = "'Tel: +99890' || lpad(p_partkey::VARCHAR, 7, '0')"
LOOSE_SQL = f"""loose AS (
SELECT p_partkey AS k, p_partkey % 7 AS v, p_name, p_size, p_type, n_name, s_suppkey,
 concat_ws(chr(10), '#ish',
  CASE p_partkey % 7 WHEN 1 THEN p_name WHEN 3 THEN {_FIRM} || ' jamoasiga ' || p_name || ' va oshpaz ishga taklif qilinadi' WHEN 4 THEN {_FIRM} || ' jamoasiga xodimlar ishga taklif qilinadi'
   ELSE {_FIRM} || ' jamoasiga ' || p_name || ' ishga taklif qilinadi' END,
  CASE WHEN p_partkey % 7 = 4 THEN 'Bo''sh ish o''rinlari:' || chr(10) || '• ' || p_name || chr(10) || '• yordamchi' || chr(10) || 'Ish joyi: ' || {_FIRM} END,
  CASE WHEN p_partkey % 7 <> 5 THEN 'Talablar:' || chr(10) || '• Tajriba ' || p_size || ' yil' || chr(10) || 'Oylik: ' || p_size || ' mln' || chr(10) || 'Manzil: ' || n_name || chr(10) || 'Mo''ljal: ' || p_type || chr(10) || 'Ish vaqti: 09:00 - 18:00' END,
  CASE WHEN p_partkey % 7 NOT IN (2, 5) THEN 'Bog''lanish:' || chr(10) || '@hr_' || s_suppkey || 'x' END, CASE WHEN p_partkey % 7 <> 2 THEN {_TEL} END) AS description
FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = s_nationkey)"""
STORY_SQL = f"""story AS (
SELECT p_partkey AS k, p_partkey % 5 AS v, p_name, p_size, n_name, s_suppkey, CASE WHEN p_partkey % 5 = 2 THEN 'placeholder' ELSE p_name END AS title,
 concat_ws(chr(10), '#ish', '"' || {_FIRM} || '" fabrikasi', 'Jamoamizga qo''shilishni xohlaysizmi', 'Oylik maoshlar razryadga qarab:', '2-razryad: ' || p_size || ' mln', '✓ Har oyda premiya', 'Manzil: ' || n_name,
  CASE WHEN p_partkey % 5 <> 1 THEN {_TEL} END) AS description
FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON n_nationkey = s_nationkey)"""


def posts_of(spark: SparkSession, sf_dir: str, name: str, title, described) -> DataFrame:
    """Raw posts of parts with their supplier and nation: described(v-independent columns) makes the text."""
    part, supplier, nation = (read(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    n = supplier.count()
    rows = part.join(supplier, F.col("s_suppkey") == F.col("p_partkey") % n).join(F.broadcast(nation), F.col("n_nationkey") == F.col("s_nationkey"))
    null = F.lit(None).cast("string")
    return rows.select(
        F.col("p_partkey").alias("k"), title.alias("title"), null.alias("company"), described.alias("description"), null.alias("salary"), null.alias("location"), F.lit(name).alias("source"),
        F.concat(F.lit(f"https://t.me/{name}/"), F.col("p_partkey").cast("string")).alias("url"), F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 60).alias("posted_at"), F.array().cast("array<string>").alias("contact_links"),
    )


def _text(*parts):
    return F.concat(*(F.lit(x) if isinstance(x, str) and not x.startswith("$") else F.col(x[1:]).cast("string") if isinstance(x, str) else x for x in parts))


def raw_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, firm = F.col("p_partkey") % 7, _text("Firma", "$s_suppkey")
    head = (
        F.when(v == 1, F.col("p_name")).when(v == 3, _text(firm, " jamoasiga ", "$p_name", " va oshpaz ishga taklif qilinadi")).when(v == 4, _text(firm, " jamoasiga xodimlar ishga taklif qilinadi"))
        .otherwise(_text(firm, " jamoasiga ", "$p_name", " ishga taklif qilinadi"))
    )
    listed = F.when(v == 4, _text("Bo'sh ish o'rinlari:\n• ", "$p_name", "\n• yordamchi\nIsh joyi: ", firm))
    body = F.when(v != 5, _text("Talablar:\n• Tajriba ", "$p_size", " yil\nOylik: ", "$p_size", " mln\nManzil: ", "$n_name", "\nMo'ljal: ", "$p_type", "\nIsh vaqti: 09:00 - 18:00"))
    reach = F.when(~v.isin(2, 5), _text("Bog'lanish:\n@hr_", "$s_suppkey", "x"))
    tel = F.when(v != 2, _text("Tel: +99890", F.lpad(F.col("p_partkey").cast("string"), 7, "0")))
    return posts_of(spark, sf_dir, "xorazm_ish", F.lit("placeholder"), F.concat_ws("\n", F.lit("#ish"), head, listed, body, reach, tel))


def raw_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_partkey") % 5
    told = _text('"Firma', "$s_suppkey", "\" fabrikasi\nJamoamizga qo'shilishni xohlaysizmi\nOylik maoshlar razryadga qarab:\n2-razryad: ", "$p_size", " mln\n✓ Har oyda premiya\nManzil: ", "$n_name")
    tel = F.when(v != 1, _text("Tel: +99890", F.lpad(F.col("p_partkey").cast("string"), 7, "0")))
    return posts_of(spark, sf_dir, "xorazm_ish", F.when(v == 2, "placeholder").otherwise(F.col("p_name")), F.concat_ws("\n", F.lit("#ish"), told, tel))


_PHONE = "'+99890' || lpad(k::VARCHAR, 7, '0')"


@query(f"""WITH {LOOSE_SQL} SELECT k, CASE WHEN v <> 5 THEN 'Tajriba ' || p_size || ' yil' END AS requirements, CASE WHEN v <> 5 THEN '09:00 - 18:00' END AS work_schedule, NULL::VARCHAR AS additional,
CASE WHEN v NOT IN (2, 5) THEN 'hr_' || s_suppkey || 'x' END AS contact_text, CASE WHEN v = 2 THEN '' ELSE {_PHONE} END AS phones, CASE WHEN v IN (2, 5) THEN '' ELSE 'hr_' || s_suppkey || 'x' END AS names FROM loose""")
def details_by_source(spark, sf_dir):
    """Details of loosely labelled posts by the rules of their source."""
    d = source_details(raw_loose(spark, sf_dir))
    return d.select("k", "requirements", "work_schedule", "additional", "contact_text", F.array_join("contact_phone_numbers", ",").alias("phones"), F.array_join("contact_telegram_usernames", ",").alias("names"))


@query(f"""WITH {LOOSE_SQL} SELECT k, 'Bepul tushlik' AS benefits, '20-30 yosh qizlar' AS requirements, 'Mijozlar bilan ishlash ' || p_size AS responsibilities, '09:00 - 18:00' AS work_schedule FROM loose""")
def details_with_about(spark, sf_dir):
    """Lines of a section about the work, sorted into the other sections; a label of the source's own is rewritten."""
    about = _text("Ish haqida:\n• Mijozlar bilan ishlash ", "$p_size", "\n• 20-30 yosh qizlar\n• Bepul tushlik\nIsh jadvali: 09:00 - 18:00\nAsosiy kanal")
    d = about_details.details_with_about(posts_of(spark, sf_dir, "ishchi_bor_kerak_toshkent", F.lit("placeholder"), about))
    return d.select("k", "benefits", "requirements", "responsibilities", "work_schedule")


@query("""SELECT p_partkey AS k, p_name AS title, 'Firma' || s_suppkey AS company, '18 - 35 yosh' AS requirements, 'Mijozlar bilan ishlash ' || p_size || chr(10) || 'Sotuvni amalga oshirish' AS responsibilities, 'Bepul tushlik' || chr(10) || 'Bonus beriladi' AS benefits,
'09:00 dan 18:00 gacha' AS work_schedule, '+99890' || lpad(p_partkey::VARCHAR, 7, '0') AS phones, 'hr_' || s_suppkey || 'x' AS names FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)""")
def parse_structured_with_own_details(spark, sf_dir):
    """Strictly labelled posts of a source whose own rules find more: sections are merged with the lines about the work."""
    told = _text(
        "Lavozim: ", "$p_name", "\nKompaniya: Firma", "$s_suppkey", "\nMaosh: ", "$p_size", " mln\nHudud: Toshkent\n📣 Ish haqida:\n– Mijozlar bilan ishlash ", "$p_size", "\n– Bonus beriladi\n– Sotuvni amalga oshirish\n❗️ Talablar:\n– 18 - 35 yosh\nQulayliklar:\n- Bepul tushlik\n⏰ Ish vaqti:\n– 09:00 dan 18:00 gacha\n☎️ Bog‘lanish:\n– +99890",
        F.lpad(F.col("p_partkey").cast("string"), 7, "0"), "\n– @hr_", "$s_suppkey", "x",
    )
    posts = posts_of(spark, sf_dir, "ishchi_bor_kerak_toshkent", F.lit("raw_post"), told)
    p = dedup.written(parse_structured(dedup.written(with_own_details(about_details.details_with_about(posts)))))
    return p.where("ok").select("k", F.col("parsed_title").alias("title"), F.col("parsed_company").alias("company"), "requirements", "responsibilities", "benefits", "work_schedule", F.array_join("contact_phone_numbers", ",").alias("phones"), F.array_join("contact_telegram_usernames", ",").alias("names"))


_LOOSE_OK = "v IN (0, 6)"
_LOOSE_REASON = "CASE v WHEN 1 THEN 'missing_company' WHEN 2 THEN 'missing_contact' WHEN 3 THEN 'multiple_roles_detected' WHEN 5 THEN 'too_few_optional_fields' END"


@query(f"""WITH {LOOSE_SQL} SELECT k, {_LOOSE_OK} AS ok, CASE v WHEN 4 THEN 'multiple_roles_detected' ELSE {_LOOSE_REASON} END AS reason, CASE WHEN {_LOOSE_OK} THEN p_name END AS title, CASE WHEN {_LOOSE_OK} THEN {_FIRM} || ' jamoasi' END AS company,
CASE WHEN {_LOOSE_OK} THEN p_size || ' mln' END AS salary, CASE WHEN {_LOOSE_OK} THEN n_name || ' (' || p_type || ')' END AS location FROM loose""")
def parse_semi_structured_ads(spark, sf_dir):
    p = semi_structured.parse_semi_structured(source_details(raw_loose(spark, sf_dir)))
    return p.select("k", "ok", "reason", *(F.col(f"parsed_{c}").alias(c) for c in ("title", "company", "salary", "location")))


@query(f"""WITH {LOOSE_SQL}, r AS (SELECT k, unnest([p_name, 'yordamchi']) AS title, unnest([1, 2]) AS role, p_size, n_name, p_type, s_suppkey FROM loose WHERE v = 4)
SELECT 'https://t.me/xorazm_ish/' || k AS url, {_LOOSE_OK} AS ok, {_LOOSE_REASON} AS reason, CASE WHEN {_LOOSE_OK} THEN p_name END AS title, CASE WHEN {_LOOSE_OK} THEN {_FIRM} || ' jamoasi' END AS company FROM loose WHERE v <> 4
UNION ALL SELECT 'https://t.me/xorazm_ish/' || k || '#role-' || role, true, NULL, title, {_FIRM} FROM r""")
def parse_many_ads(spark, sf_dir):
    """Lists of roles are split into a post for each."""
    p = semi_structured.parse_many(raw_loose(spark, sf_dir), source_details)
    return p.select("url", "ok", "reason", F.col("parsed_title").alias("title"), F.col("parsed_company").alias("company"))


@query(f"""WITH {STORY_SQL} SELECT k, v NOT IN (1, 2) AS ok, CASE v WHEN 1 THEN 'missing_structured_labels' WHEN 2 THEN 'missing_title' END AS reason, CASE WHEN v NOT IN (1, 2) THEN p_name END AS title, CASE WHEN v NOT IN (1, 2) THEN {_FIRM} || ' fabrikasi' END AS company,
CASE WHEN v NOT IN (1, 2) THEN 'Oylik maoshlar razryadga qarab:' || chr(10) || '2-razryad: ' || p_size || ' mln' END AS salary, CASE WHEN v NOT IN (1, 2) THEN n_name END AS location, CASE WHEN v NOT IN (1, 2) THEN 'Har oyda premiya' END AS benefits FROM story""")
def parse_narrative_ads(spark, sf_dir):
    p = narrative.parse_narrative(source_details(raw_story(spark, sf_dir)))
    return p.select("k", "ok", "reason", *(F.col(f"parsed_{c}").alias(c) for c in ("title", "company", "salary", "location")), F.when(F.col("ok"), F.col("benefits")).alias("benefits"))


@query(f"""WITH {ADS_SQL}, {LOOSE_SQL}, {STORY_SQL}
SELECT 'ads' AS kind, k, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title, s_name AS company FROM ads WHERE v IN (0, 6)
UNION ALL SELECT 'loose', k, upper(substr(p_name, 1, 1)) || substr(p_name, 2), {_FIRM} || ' jamoasi' FROM loose WHERE {_LOOSE_OK}
UNION ALL SELECT 'loose', k, upper(substr(t, 1, 1)) || substr(t, 2), {_FIRM} FROM (SELECT k, s_suppkey, unnest([p_name, 'yordamchi']) AS t FROM loose WHERE v = 4)
UNION ALL SELECT 'story', k, upper(substr(p_name, 1, 1)) || substr(p_name, 2), {_FIRM} || ' fabrikasi' FROM story WHERE v NOT IN (1, 2)""")
def ingest_cascade(spark, sf_dir):
    """All posts through all parsers, the first that accepts one deciding."""
    named = [(kind, df.drop("k").withColumn("url", F.concat("url", F.lit(f"?{kind}")))) for kind, df in (("ads", raw_ads(spark, sf_dir)), ("loose", raw_loose(spark, sf_dir)), ("story", raw_story(spark, sf_dir)))]
    every = named[0][1].unionByName(named[1][1]).unionByName(named[2][1])
    table = jobs.ingest_raw(every, F.lit("2024-01-01").cast("timestamp"))
    part = lambda i: F.regexp_extract("source_url", r"/(\d+)\?(\w+)", i)
    return table.select(part(2).alias("kind"), part(1).cast("long").alias("k"), "title", "company")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts -> raw events -> both hashes -> newest of each post and content -> what a chat has not had -> the 25 oldest."""
    d = raw_documents(spark, sf_dir)
    keyed = d.select(
        F.col("doc_id").alias("id"), "title", "source", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).cast("timestamp_ntz").alias("posted_at"), F.lit(0).alias("created_at"),
        hashing.source_post_hash(F.col("source"), F.col("url")).alias("source_post_hash"), F.sha2(text.normalize_key(F.col("description")), 256).alias("dedup_hash"),
    )
    kept = dedup.dedup_latest(keyed, ["source_post_hash", "dedup_hash"], [F.desc("posted_at"), F.desc("id")])
    posts = d.where(F.col("doc_id") % 5 == 0).select(F.col("doc_id").alias("job_id"), F.lit("chat").alias("channel_chat_id"))
    return publication.ready_for_publication(kept, posts, "chat", 25).select("id", "title", "source", "posted_at", "source_post_hash", "dedup_hash")


QUERIES["flagship"] = flagship
SQL["flagship"] = f"""SELECT doc_id AS id, title, source, posted_at, sha256({_NORM.format('source')} || '|' || {_NORM.format("'https://t.me/' || source || '/' || doc_id")}) AS source_post_hash, h AS dedup_hash
FROM (SELECT *, split_part(text, chr(10), 1) AS title, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS posted_at, sha256({_NORM.format('text')}) AS h, row_number() OVER (PARTITION BY sha256({_NORM.format('text')}) ORDER BY doc_id DESC) AS r FROM documents)
WHERE r = 1 AND doc_id % 5 <> 0 AND lower(trim(title)) NOT IN ('raw_post', 'placeholder') ORDER BY doc_id LIMIT 25"""
__all__ = ["QUERIES", "SQL", "encode_raw", "flagship"]
