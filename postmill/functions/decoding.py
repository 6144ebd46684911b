"""JSON objects to typed values, with every fault of every field instead of a null for the whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

#: What a field of each type may be in JSON, as a pattern on the type that Spark finds there.
FOUND = {
    T.StringType: "STRING", T.LongType: r"BIGINT|DECIMAL\(\d+,0\)", T.IntegerType: r"BIGINT|DECIMAL\(\d+,0\)", T.DoubleType: r"BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)", T.BooleanType: "BOOLEAN",
    T.TimestampType: "STRING", T.DateType: "STRING", T.ArrayType: r"ARRAY<.*>",
}
PROBLEMS = "array<struct<field:string,problem:string>>"


def decode_accumulating(text: Column, schema: T.StructType, required: tuple[str, ...] = ()) -> Column:
    """struct<value, problems>: the object of a JSON text, or null and all that is wrong with it.

    A field is missing, null (either only if it is required), or of another type than its own; a number is no string, a
    string no number, a fraction no whole number, and a list's elements count too. A text that is no JSON object, or null,
    has the one problem of the whole (an empty field name). Fields that the schema lacks are ignored. The text is parsed once;
    problems come in the order of the schema."""

    def fault(v: Column, field: T.StructField) -> Column:
        kind = field.dataType.simpleString()
        odd = F.lit(f"expected {kind}")
        part = F.try_variant_get(v, f"$.{field.name}", "variant")
        typed = F.try_variant_get(v, f"$.{field.name}", kind)
        needed = field.name in required

        def of(x: Column) -> Column:
            seen = F.schema_of_variant(x)
            wrong = ~seen.rlike(f"^(?:{FOUND[type(field.dataType)]})$") | typed.isNull()
            if isinstance(field.dataType, T.ArrayType):
                wrong = wrong | ~seen.rlike(f"^ARRAY<(?:VOID|{FOUND[type(field.dataType.elementType)]})>$")
            missing = F.when(x.isNull(), F.lit("missing" if needed else None).cast("string"))
            return missing.when(seen == "VOID", F.lit("null" if needed else None).cast("string")).when(wrong, odd)

        return F.struct(F.lit(field.name).alias("field"), let(part, of).alias("problem"))

    def decoded(v: Column) -> Column:
        whole = F.array(F.struct(F.lit("").alias("field"), F.lit("no JSON object").alias("problem")))
        faults = F.filter(F.array(*(fault(v, f) for f in schema)), lambda x: x.problem.isNotNull())
        problems = F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), faults).otherwise(whole).cast(PROBLEMS)
        value = F.struct(*(F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema))
        return let(problems, lambda p: F.struct(F.when(F.size(p) == 0, value).alias("value"), p.alias("problems")))

    return let(F.try_parse_json(text), decoded)
