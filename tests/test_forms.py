"""Query strings, JSON bodies and parts of forms."""

from pyspark.sql import functions as F

from postmill.functions import forms


def test_query_strings(spark):
    rows = [([("q", "a b"), ("ў&", "x=1/~*")], "q=a+b&%D1%9E%26=x%3D1%2F%7E*"), ([("a", None), ("b", "")], "b="), ([], ""), (None, "")]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(rows)], "i int, e array<struct<k:string,v:string>>").select("i", F.map_from_entries("e").alias("m"))
    got = df.orderBy("i").select(forms.query_string(F.col("m")).alias("q"), forms.with_query(F.lit("/p"), F.col("m")).alias("u")).collect()
    assert [r.q for r in got] == [x for _, x in rows]
    assert [r.u for r in got] == ["/p" + ("?" + x if x else "") for _, x in rows]


def test_bodies_hold_no_nulls_at_any_depth(spark):
    kind = "struct<a:string,b:struct<c:int,d:array<struct<e:string>>>,m:map<string,array<int>>,n:array<map<string,string>>>"
    rows = [
        ("x", (None, [None, (None,), ("y",)]), {"k": [None, 1], "z": None}, [None, {"p": None}, {"q": "r"}]),
        (None, None, None, None),
        ("", (1, []), {}, []),
    ]
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, v {kind}")
    got = [r.j for r in df.orderBy("i").select(forms.json_body(F.col("v"), df.schema["v"].dataType).alias("j")).collect()]
    assert got == ['{"a":"x","b":{"d":[{},{"e":"y"}]},"m":{"k":[1]},"n":[{},{"q":"r"}]}', "{}", '{"a":"","b":{"c":1,"d":[]},"m":{},"n":[]}']
    none = spark.createDataFrame([(None,)], "v struct<a:int>")
    assert none.select(forms.json_body(F.col("v"), none.schema["v"].dataType)).first()[0] is None


def test_the_last_part_of_a_name_counts(spark):
    rows = [([("a", "1"), (" ", "x"), (None, "y"), ("b", None), ("a", "2"), ("A", "3")],), (None,), ([],), ([("  ", "z")],)]
    df = spark.createDataFrame(rows, "p array<struct<name:string,text:string>>")
    assert [r[0] for r in df.select(forms.text_parts(F.col("p"))).collect()] == [{"a": "2", "b": "", "A": "3"}, {}, {}, {}]
