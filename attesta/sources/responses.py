"""Responses of services as tables: tolerant readers of their JSON, and recorded attempts with what became of them.

JSON is read as VARIANT, so that a field may have any type in any row; readers take the first key that holds what they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys under which elements hold their text, page number and box.
TEXT_KEYS = ("text", "content", "Content", "textContent", "TEXT")
PAGE_KEYS = ("page", "pageNumber", "page_number", "pageIndex", "pagenum")
BOX_KEYS = ("boundingBox", "box", "bbox")
SIDES = {"x": ("x", "left"), "y": ("y", "top"), "w": ("width", "w"), "h": ("height", "h")}
#: Where a response holds its elements, the first that is a list.
ELEMENTS = ("$.elements", "$.content.elements", "$", "$.data", "$.data.elements", "$.result", "$.result.elements", "$.response", "$.response.elements")
#: Answers after which a request is sent again, and how often.
RETRIED, RETRIES = (429, 500, 502, 503, 504), 1


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """path, key (the file's name without its ending, as caches have it), body: a row for each file, read whole."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("key"), F.col("value").alias("body"))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _string(v: Column, path: str) -> Column:
    """The value at path if it is a string."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, path, "double"))


def _true(v: Column, path: str) -> Column:
    """Whether something stands at path that isn't null, false, zero or empty."""
    return ~F.coalesce(F.to_json(F.try_variant_get(v, path, "variant")).rlike(r'^(null|false|-?0(\.0*)?(E-?\d+)?|""|\[\]|\{\})$'), F.lit(True))


def element_text(e: Column) -> Column:
    """The first string among the text keys, else the text within content, else nothing."""
    within = F.when(_true(e, "$.content.text"), _string(e, "$.content.text")).otherwise(_string(e, "$.content.Content"))
    return F.coalesce(*(_string(e, f"$.{k}") for k in TEXT_KEYS), F.when(_kind(e, "$.content").startswith("OBJECT"), within), F.lit(""))


def element_category(e: Column) -> Column:
    """The category, of a list the first."""
    return F.coalesce(_string(e, "$.category"), F.try_variant_get(e, "$.category[0]", "string"), F.lit(""))


def element_page(e: Column) -> Column:
    return F.coalesce(*(_number(e, f"$.{k}").cast("int") for k in PAGE_KEYS), F.lit(0))


def element_box(e: Column) -> Column:
    """struct(x, y, w, h): of an object or a list of four under one of three keys, else the extent of the corners in coordinates."""
    box = F.coalesce(*(F.when(_true(e, f"$.{k}"), F.try_variant_get(e, f"$.{k}", "variant")) for k in BOX_KEYS))
    some = lambda p: F.nullif(F.try_variant_get(box, p, "double"), F.lit(0.0))
    named = F.struct(*(F.coalesce(*(some(f"$.{k}") for k in keys), F.lit(0.0)).alias(side) for side, keys in SIDES.items()))
    four = F.struct(*(F.try_variant_get(box, f"$[{i}]", "double").alias(side) for i, side in enumerate(SIDES)))
    corners = F.try_variant_get(e, "$.coordinates", "array<struct<x double, y double>>")
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    low = {"x": F.array_min(xs), "y": F.array_min(ys), "w": F.array_max(xs) - F.array_min(xs), "h": F.array_max(ys) - F.array_min(ys)}
    extent = F.struct(*(v.alias(k) for k, v in low.items()))
    kind = F.schema_of_variant(box)
    return F.when(kind.startswith("OBJECT"), named).when(kind.startswith("ARRAY") & F.try_variant_get(box, "$[3]", "double").isNotNull(), four).when(box.isNull() & corners.isNotNull(), extent)


def _payload(responses: DataFrame, body: str) -> DataFrame:
    return responses.withColumn("v", F.try_parse_json(F.col(body)))


def _list(paths: tuple) -> Column:
    return F.coalesce(*(F.try_variant_get("v", p, "array<variant>") for p in paths))


def elements_of(responses: DataFrame, body: str = "body") -> DataFrame:
    """Elements of parse responses: the columns of responses but body, and ord, id, page, category, text, x, y, w, h. Responses
    without elements have none; response_state tells why."""
    kept = [c for c in responses.columns if c != body]
    e = _payload(responses, body).select(*kept, F.posexplode(_list(ELEMENTS)).alias("ord", "e"))
    v = F.col("e")
    box = element_box(v)
    e = e.select(*kept, "ord", F.try_variant_get(v, "$.id", "int").alias("id"), element_page(v).alias("page"), element_category(v).alias("category"), element_text(v).alias("text"), box.alias("box"))
    return e.select(*kept, "ord", "id", "page", "category", "text", *(F.col(f"box.{k}").alias(k) for k in SIDES))


def response_state(responses: DataFrame, body: str = "body") -> DataFrame:
    """responses with state: parsed, no_elements, not_json, or missing (no body)."""
    state = F.when(F.col(body).isNull(), "missing").when(F.col("v").isNull(), "not_json").when(_list(ELEMENTS).isNull(), "no_elements").otherwise("parsed")
    return _payload(responses, body).withColumn("state", state).drop("v")


#: Fields of a reference and their types.
REFERENCE = {"id": "string", "raw": "string", "doi": "string", "arxiv": "string", "url": "string", "year": "string", "title": "string", "first_author": "string", "kind": "string", "confidence": "double"}


def references_of(responses: DataFrame, body: str = "body") -> DataFrame:
    """References of JSON with items, or that is a list: the columns of responses but body, and ord, id, raw, doi, arxiv, url,
    year, title, first_author, kind, confidence, notes. A field that is absent, null or of another kind is null."""
    kept = [c for c in responses.columns if c != body]
    e = _payload(responses, body).select(*kept, F.posexplode(_list(("$.items", "$"))).alias("ord", "e"))
    return e.select(*kept, "ord", *(F.try_variant_get("e", f"$.{k}", kind).alias(k) for k, kind in REFERENCE.items()), F.try_variant_get("e", "$.notes", "array<string>").alias("notes"))


def settled(attempts: DataFrame, retries: int = RETRIES) -> DataFrame:
    """attempts: key, attempt, status (null where no answer came), body. One row a key: key, tries, status, body, state.

    An attempt without an answer, or with one of RETRIED, is followed by another one, `retries` times; the first that isn't,
    or the last, counts. state: ok (200), http_error, unreachable (no answer), or retry if the last is still to come.
    """
    order = Window.partitionBy("key").orderBy("attempt")
    again = F.col("status").isNull() | F.col("status").isin(*RETRIED)
    a = attempts.select("key", "attempt", "status", "body").withColumn("tries", F.row_number().over(order)).where(F.col("tries") <= retries + 1)
    # At most retries + 1 rows a key: the first final one, else the last.
    final = ~again | (F.col("tries") > retries)
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(final), F.when(final, F.col("tries")).otherwise(-F.col("tries"))))
    a = a.withColumns({"final": final, "k": best}).where("k = 1")
    state = F.when(~F.col("final"), "retry").when(F.col("status") == 200, "ok").when(F.col("status").isNull(), "unreachable").otherwise("http_error")
    return a.select("key", "tries", "status", "body", state.alias("state"))


def answered(wanted: DataFrame, attempts: DataFrame, retries: int = RETRIES) -> DataFrame:
    """wanted (key and others) with tries, status, body and state of what was recorded; missing where nothing was."""
    s = settled(attempts, retries)
    return wanted.join(s, "key", "left").withColumns({"tries": F.coalesce("tries", F.lit(0)), "state": F.coalesce("state", F.lit("missing"))})
