"""Photos: claims about them, matching with files, detections and their risk, timelines and report blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions.text import normalize_claim, photo_sentences

MARKER = r"[\[<]?(?:사진|그림|photo)\s*(\d+)[\]>]?"
#: Places a sentence and a file name may share.
LOCATIONS = ("하역장", "전기실", "옥외 배관", "창고", "작업구역", "1층", "2층", "3층", "4층", "5층", "A동", "B동", "C동", "로프", "사다리", "비계", "점검표", "소화전", "비상구", "안전관리자")
#: Label, severity, category, law, article.
LABELS = [
    ("corrosion", "risk", "시설 결함(부식)", "산업안전보건법", 38),
    ("crack", "risk", "시설 결함(균열)", "산업안전보건법", 38),
    ("wall_damage", "risk", "시설 결함(벽체 손상)", "산업안전보건법", 38),
    ("weld_defect", "risk", "시설 결함(용접 불량)", "산업안전보건법", 38),
    ("weld_bad", "risk", "시설 결함(용접 불량)", "산업안전보건법", 38),
    ("cable_damage", "risk", "전기 위험(케이블 손상)", "산업안전보건법", 38),
    ("no_helmet", "risk", "보호구 미착용(안전모)", "산업안전보건법", 38),
    ("no_gloves", "risk", "보호구 미착용(안전장갑)", "산업안전보건법", 38),
    ("no_goggles", "risk", "보호구 미착용(보안경)", "산업안전보건법", 38),
    ("no_shoes", "risk", "보호구 미착용(안전화)", "산업안전보건법", 38),
    ("no_mask", "risk", "보호구 미착용(호흡보호구)", "산업안전보건법", 38),
    ("cardboard", "caution", "통로·적치 위험(방치물)", "산업안전보건법", 38),
    ("plastic", "caution", "통로·적치 위험(방치물)", "산업안전보건법", 38),
    ("glass", "caution", "통로·적치 위험(방치물)", "산업안전보건법", 38),
    ("metal", "caution", "통로·적치 위험(방치물)", "산업안전보건법", 38),
    ("paper", "caution", "통로·적치 위험(방치물)", "산업안전보건법", 38),
    ("helmet", "reference", "보호구 착용(안전모)", None, None),
    ("gloves", "reference", "보호구 착용(안전장갑)", None, None),
    ("goggles", "reference", "보호구 착용(보안경)", None, None),
    ("shoes", "reference", "보호구 착용(안전화)", None, None),
    ("mask", "reference", "보호구 착용(호흡보호구)", None, None),
]
SEVERITY = {"none": 0, "reference": 1, "caution": 2, "risk": 3}
THRESHOLD = 0.45


def labels_table(spark: SparkSession, labels=LABELS) -> DataFrame:
    return spark.createDataFrame(labels, "label string, severity string, category string, law string, article int")


def photo_claims(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence and photo number in it: doc_id, sentence_no, sentence, photo_no, hints."""
    s = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(photo_sentences(F.col(text_col))).alias("sentence_no", "sentence"))
    numbers = F.array_distinct(F.regexp_extract_all("sentence", F.lit(MARKER), F.lit(1)))
    hints = F.filter(F.array(*map(F.lit, LOCATIONS)), lambda h: F.contains("sentence", h))
    return s.withColumn("hints", hints).select("*", F.explode(numbers).alias("n")).withColumn("photo_no", F.col("n").try_cast("int")).drop("n")


def match_photos(claims: DataFrame, photos: DataFrame) -> DataFrame:
    """photos: doc_id, photo_no, file, places (array; null: by file name). Adds file: the claim's number's, or that of the first hint found elsewhere.

    A number beyond the photos matches nothing, hint or not.
    """
    p = photos.select(F.col("doc_id").alias("p_doc"), F.col("photo_no").alias("p_no"), F.col("file").alias("own_file"))
    c = claims.withColumn("claim_no", F.xxhash64("doc_id", "sentence_no", "photo_no")).join(p, (F.col("doc_id") == F.col("p_doc")) & (F.col("photo_no") == F.col("p_no")), "left").drop("p_doc", "p_no")
    h = c.where("own_file IS NOT NULL").select("claim_no", F.col("doc_id").alias("h_doc"), F.posexplode("hints").alias("hint_no", "hint"))
    q = photos.select(F.col("doc_id").alias("q_doc"), F.col("photo_no").alias("q_no"), F.col("file").alias("hint_file"), "places")
    found = h.join(q, F.col("h_doc") == F.col("q_doc")).where(F.contains("hint_file", "hint") | F.array_contains(F.coalesce("places", F.array().cast("array<string>")), F.col("hint")))
    best = found.groupBy("claim_no").agg(F.min_by("hint_file", F.struct("hint_no", "q_no")).alias("hint_file"))
    return c.join(best, "claim_no", "left").withColumn("matched_file", F.coalesce("hint_file", "own_file")).drop("claim_no", "hint_file", "own_file")


#: Words of a sentence that ask for a detector, looked for in this order.
DOMAIN_WORDS = {
    "defect": ["부식", "균열", "손상", "용접", "crack", "damage", "corrosion", "weld"],
    "gauge": ["계기", "수치", "gauge", "digit", "압력", "온도", "rpm", "속도", "값", "측정", "게이지"],
    "cleaning": ["정리", "적재", "폐기물", "청소", "폐기", "방치", "쓰레기", "cleaning", "cardboard", "pile"],
}
#: Fixed value: a photo whose name has it shows a gauge.
GAUGE_NAME = "계기"


def domain(sentence: Column) -> Column:
    """Which detector a sentence asks for; that of defects if it names none."""
    out = F
    for name, words in DOMAIN_WORDS.items():
        out = out.when(F.lower(sentence).rlike("|".join(words)), name)
    return out.otherwise("defect")


def inspect(detections: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, gauge: bool = False) -> DataFrame:
    """detections: image, label, conf, and domain if there are several. Per image: severity (the highest), categories,
    n_detections; images without any are in too. With domains, gauge_run tells whether its detections of gauges count: those
    of all images, or those of images whose name says so."""
    use, more = F.col("conf") >= threshold, []
    if "domain" in detections.columns:
        shows = F.lit(gauge) | F.contains(F.element_at(F.split(F.col("image").cast("string"), "/"), -1), F.lit(GAUGE_NAME))
        use = use & ((F.coalesce("domain", F.lit("")) != "gauge") | shows)
        more = [F.max(shows).alias("gauge_run")]
    d = detections.withColumn("kept", F.coalesce(use, F.lit(False))).join(labels, "label", "left")
    rank = F.element_at(F.create_map(*(F.lit(x) for k, v in SEVERITY.items() for x in (k, v))), F.col("severity"))
    name = F.element_at(F.create_map(*(F.lit(x) for k, v in SEVERITY.items() for x in (v, k))), F.col("rank"))
    g = d.groupBy("image").agg(F.coalesce(F.max(F.when(F.col("kept"), rank)), F.lit(0)).alias("rank"), F.count_if("kept").alias("n_detections"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("kept") & (rank >= 2), F.col("category")))), ", ").alias("categories"), *more)
    return g.select("image", name.alias("severity"), "n_detections", "categories", *(["gauge_run"] if more else []))


def inspection_summary(inspected: DataFrame) -> DataFrame:
    counts = inspected.agg(F.count("*").alias("photos"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY))
    return counts.withColumn("verdict", F.when(F.col("risk") > 0, "risk").when(F.col("caution") > 0, "caution").otherwise("none"))


def match_verdict(claims: DataFrame) -> DataFrame:
    """claims: verdict, quote, detected (array of labels). No detection, or support by a label not detected, can't be judged."""
    named = F.array_contains(F.transform("detected", normalize_claim), normalize_claim(F.col("quote")))
    v = F.when(F.size("detected") == 0, "cannot_judge").when((F.col("verdict") == "supported") & ~F.coalesce(named, F.lit(False)), "cannot_judge").otherwise(F.col("verdict"))
    return claims.withColumn("final_verdict", v)


def detection_summary(detections: DataFrame) -> DataFrame:
    """image, summary: 'label(0.84), ...', the surest first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), "label")))
    text = F.transform(ordered, lambda d: F.format_string("%s(%.2f)", d["label"], -d["c"]))
    return detections.groupBy("image").agg(F.array_join(text, ", ").alias("summary"))


def sample_frames(frames: DataFrame, rate: Column, most: int = 24) -> DataFrame:
    """frames: video, idx. Every rate-th frame, the first `most` of each video."""
    kept = frames.where(F.pmod(F.col("idx"), F.greatest(F.lit(1), F.round(rate))) == 0)
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("video").orderBy("idx"))).where(F.col("k") <= most)


def sample_seconds(frames: DataFrame, most: int = 40) -> DataFrame:
    """frames: video, idx, t. Frames within ten milliseconds of a whole second, the first `most` of each video."""
    kept = frames.where(F.abs(F.col("t") - F.round("t")) < 0.01)
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("video").orderBy("idx"))).where(F.col("k") <= most)


def timeline(events: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """events: ts, label, conf. Per second: severity, labels, n."""
    d = events.where(F.col("conf") >= threshold).join(F.broadcast(labels), "label", "left")
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in SEVERITY.items() for x in (k, v))), F.col("severity")), F.lit(0))
    name = F.element_at(F.create_map(*(F.lit(x) for k, v in SEVERITY.items() for x in (v, k))), F.col("rank"))
    g = d.groupBy(F.date_trunc("second", "ts").alias("second")).agg(F.max(rank).alias("rank"), F.array_sort(F.collect_set("label")).alias("labels"), F.count("*").alias("n"))
    return g.select("second", name.alias("severity"), "labels", "n")


def label_frequency(detections: DataFrame) -> DataFrame:
    return detections.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def valid_tags(blocks: DataFrame, detections: DataFrame) -> DataFrame:
    """blocks: block_id, text with tags [사진n:label 0.84]; adds valid: every tag is a detection at two decimals."""
    tags = blocks.select("block_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[사진\d+:([a-z_]+ \d\.\d\d)\]"), F.lit(1))).alias("tag"))
    have = detections.select(F.format_string("%s %.2f", "label", "conf").alias("tag")).distinct()
    bad = tags.join(have, "tag", "left_anti").select("block_id").distinct().withColumn("bad", F.lit(True))
    return blocks.join(bad, "block_id", "left").withColumn("valid", F.col("bad").isNull()).drop("bad")


def without_bad_articles(blocks: DataFrame, bad: DataFrame) -> DataFrame:
    """Blocks (block_id, text) that cite none of the bad articles (article)."""
    cited = blocks.select("block_id", F.explode(F.regexp_extract_all("text", F.lit(r"제\s*(\d+)\s*조"), F.lit(1))).alias("a")).select("block_id", F.col("a").cast("int").alias("article"))
    return blocks.join(cited.join(bad, "article", "left_semi").select("block_id").distinct(), "block_id", "left_anti")
