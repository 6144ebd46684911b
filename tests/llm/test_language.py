"""Languages by compression: held-out labels, texts of every kind, and the sizes by hand."""

import zlib

import zstandard as zstd

from postmill.llm.language import Coder, dictionaries, identify_language, plain

SF = "/root/testdata/sf0.01"


def test_held_out_documents_get_their_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in identify_language(docs).collect()}
    known = {r.doc_id: (r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()}
    assert rows.keys() == known.keys()
    judged = [(rows[i], lang) for i, (lang, text) in known.items() if lang and any(x.isalpha() for x in text) and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in judged) and len(judged) > 100
    right = [r.lang_pred == lang for r, lang in judged]
    assert sum(right) >= 0.95 * len(right)
    sure = [r.lang_pred == lang for r, lang in judged if r.accepted]
    assert sum(sure) >= 0.99 * len(sure) and len(sure) > 0.8 * len(right)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_the_held_out_fold_and_labels_of_judged_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 'xx' else lang end as lang", "'z' as source", "1 as id_", "2 as lang_", "3 as turn")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(identify_language(other)) == key(identify_language(docs))


def test_sizes_by_hand_and_odd_texts(spark, docs, empty):
    held = dictionaries(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text", "lang", 300, 8192)
    assert all(len(words) <= 8192 for _, words in held.values())
    coder = Coder(held, 6, 512)
    text = "The house of the other one, and 12 more of them! " * 40
    raw = plain(text)
    sizes = {}
    for lang, (_, words) in held.items():
        one = zstd.ZstdCompressor(level=6, dict_data=zstd.ZstdCompressionDict(words, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False)
        sizes[lang] = sum(len(one.compress(raw[i : i + 512])) for i in range(0, len(raw), 512))
    least, second = sorted(sizes.values())[:2]
    lang, score = coder.best(text)
    assert sizes[lang] == least and abs(score - (second - least) / second) < 1e-12
    for odd in (None, "", " \n", "12 34", "½²", "!?"):
        assert coder.best(odd) == ("und", 0.0)
    assert Coder({}, 6, 512).best("word") == ("und", 0.0)
    assert Coder({"en": held["en"]}, 6, 512).best("word")[0] == "en"
    got = identify_language(docs).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got} == {"und", "en"}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert all((r.lang_pred == "und") == (not any(x.isalpha() for x in texts[r.doc_id] or "")) for r in got if r.doc_id is not None)
    assert all(r.held_out for r in got if r.doc_id is None)
    unlabelled = identify_language(docs.withColumn("lang", docs.lang.substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') as lang")).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in unlabelled} == {("und", 0.0, False)}
    assert identify_language(empty).collect() == []
