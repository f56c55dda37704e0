"""Record validation compiled from a schema, and names found inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEM = "array<struct<path:string,message:string>>"
#: Names that every task holds in an automaton; more are refused.
MAX_NAMES = 100_000


def problems(schema: dict, value: Column, path: Column | None = None) -> Column:
    """An array of (path, message), one for each breach of a schema by a nested value; items of arrays have their index in the path.

    Of JSON Schema: properties, required, items, minItems, enum, minimum, maximum, minLength, pattern. Nulls are as good as missing:
    only required speaks of them. Everything is one expression, so a check is a projection without a shuffle.
    """
    path = F.lit("") if path is None else path
    one = lambda bad, message: F.when(bad & value.isNotNull(), F.array(F.struct(path.alias("path"), message.alias("message"))))
    found: list[Column] = []
    if "enum" in schema:
        found.append(one(~value.isin(schema["enum"]), F.concat(value.cast("string"), F.lit(f" is not one of {', '.join(map(str, schema['enum']))}"))))
    if "minimum" in schema:
        found.append(one(value < schema["minimum"], F.concat(value.cast("string"), F.lit(f" is less than {schema['minimum']}"))))
    if "maximum" in schema:
        found.append(one(value > schema["maximum"], F.concat(value.cast("string"), F.lit(f" is greater than {schema['maximum']}"))))
    if "minLength" in schema:
        found.append(one(F.length(F.trim(value)) < schema["minLength"], F.lit(f"is shorter than {schema['minLength']}")))
    if "pattern" in schema:
        found.append(one(~value.rlike(schema["pattern"]), F.concat(value, F.lit(f" does not match {schema['pattern']}"))))
    if "minItems" in schema:
        found.append(one(F.size(value) < schema["minItems"], F.lit(f"has fewer than {schema['minItems']} items")))
    child = lambda name: F.concat(path, F.when(path == "", "").otherwise("."), F.lit(name))
    for name in schema.get("required", ()):
        missing = F.when(value.isNotNull() & value[name].isNull(), F.array(F.struct(child(name).alias("path"), F.lit("is required").alias("message"))))
        found.append(missing)
    for name, inner in schema.get("properties", {}).items():
        found.append(problems(inner, value[name], child(name)))
    if "items" in schema:
        each = F.transform(value, lambda x, i: problems(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.flatten(each))
    if not found:
        return F.array().cast(PROBLEM)
    return F.concat(*[F.coalesce(f.cast(PROBLEM), F.array().cast(PROBLEM)) for f in found])


def first_contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts: (id, text), names: (name_id, name). (id, name_id): the smallest name id whose name stands in the text or holds the text,
    without case. Null and empty names and texts match nothing; a table of more than MAX_NAMES names is refused.

    A text is walked once by an automaton of all names, however many there are; what holds a text is looked up among the parts of names
    of its length."""
    import pyarrow as pa

    rows = names.where("name_id IS NOT NULL AND length(name) > 0").groupBy(F.lower("name").alias("name")).agg(F.min("name_id").alias("name_id")).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    held = texts.sparkSession.sparkContext.broadcast(sorted((r.name_id, r.name) for r in rows))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, name in held.value:
            found.add_word(name, i)
        if held.value:
            found.make_automaton()
        longest, parts = max((len(n) for _, n in held.value), default=0), {}
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                low = (text or "").lower()
                best = min((i for _, i in found.iter(low)), default=None) if held.value and low else None
                if low and len(low) < longest:
                    if low not in parts:
                        if len(parts) > 100_000:
                            parts.clear()
                        parts[low] = min((i for i, n in held.value if low in n), default=None)
                    best = min((x for x in (best, parts[low]) if x is not None), default=None)
                out.append(best)
            ids = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], ["id", "name_id"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, name_id long").where("name_id IS NOT NULL")
