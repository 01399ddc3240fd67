"""Vector search, hybrid retrieval, answer cache, digests and metrics (TOP-1, SET-*, MTH-1, ETL-21..36, AGG-14..24, UI-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def vector_top_k(chunks: DataFrame, query: list[float], k: int = 8) -> DataFrame:
    """The k rows of chunks(id, embedding) nearest to one vector: a scan and a bounded top-k, no shuffle of rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return chunks.select("id", F.round(cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid(exact: DataFrame, vector: DataFrame) -> DataFrame:
    """Exact-text hits first, then vector hits that are not among them (id, rank)."""
    both = exact.select("id", F.lit(0).alias("source"), "rank").union(vector.select("id", F.lit(1).alias("source"), "rank"))
    first = both.groupBy("id").agg(F.min(F.struct("source", "rank")).alias("m"))
    return first.select("id", "m.source", "m.rank")


def cached_answer(cache: DataFrame, query: list[float], least: float = 0.95) -> DataFrame:
    """The best cached answer of at least the similarity; of ties the one touched last."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return cache.withColumn("similarity", cosine(F.col("embedding"), q)).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), F.desc("last_touch"), "key").limit(1)


def cache_key(question: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.trim(question)).cast("binary")), 1, 16)


def invalidated(cache: DataFrame, touched: Column) -> DataFrame:
    return cache.where(~F.arrays_overlap("cited_nodes", touched))


def evicted(cache: DataFrame, keep: int = 300) -> DataFrame:
    """The ``keep`` answers touched last."""
    return cache.orderBy(F.desc("last_touch"), "key").limit(keep)


def transcript_tail(turns: DataFrame, n: int = 4, clip: int = 400) -> DataFrame:
    """The last n turns of each conversation; long texts are clipped with an ellipsis."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    tail = turns.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    clipped = F.when(F.length("text") > clip, F.concat(F.substring("text", 1, clip), F.lit("…"))).otherwise(F.col("text"))
    return tail.select("conv_id", "turn", "role", clipped.alias("text"))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic embedding: each word adds +-1 / (1 + 0.1 i) at the place its MD5 names; unit length.
    An empty text is the first unit vector."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    number = lambda hexes: F.conv(hexes, 16, 10).cast("bigint")
    # the whole 128-bit digest modulo dim, 16 bits at a time; the sign is its bit 4
    place = lambda h: F.aggregate(F.sequence(F.lit(1), F.lit(29), F.lit(4)), F.lit(0).cast("bigint"), lambda r, k: (r * 65536 + number(F.substr(h, k, F.lit(4)))) % dim)
    sign = lambda h: F.when(F.floor(number(F.substr(h, F.lit(31), F.lit(2))) / 16) % 2 == 1, 1.0).otherwise(-1.0)
    hashed = F.transform(words, lambda w: F.md5(w.cast("binary")))
    signed = F.transform(hashed, lambda h, i: F.struct(place(h).cast("int").alias("at"), (sign(h) / (1 + 0.1 * i)).alias("x")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(F.filter(signed, lambda s: s["at"] == k), F.lit(0.0), lambda t, s: t + s["x"]))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    first = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    return F.when(norm(raw) > 0, F.transform(raw, lambda x: x / norm(raw))).otherwise(first)


def fitted_vector(v: Column, dim: int) -> Column:
    """Cut or padded with zeros to ``dim`` components, then of unit length."""
    fit = F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim)
    norm = F.sqrt(dot(fit, fit))
    return F.when(norm > 0, F.transform(fit, lambda x: x / norm)).otherwise(fit)


def compliance_position(rows: DataFrame, today: str) -> DataFrame:
    """Rows(equipment, standard, next_due) with status and id; empty dates are left out."""
    from millrace.functions.rules import due_status

    due = rows.where("next_due is not null and next_due <> ''")
    return due.select(F.concat_ws(":", F.lit("compliance"), "equipment", "standard", "next_due").alias("id"), "equipment", "standard", "next_due", due_status(F.col("next_due"), today).alias("status"))


def compliance_items(rows: DataFrame, today: str) -> DataFrame:
    """ETL-23, TOP-4: rows(equipment, standard, inspection_type, next_due, last_inspection, revision, doc_id, page) as the items of the position, what is overdue first, then by date.

    Rows without a date are left out; missing texts are empty, a missing type is 'Inspection'.
    """
    from millrace.functions.rules import due_status

    text = lambda c, default="": F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)).alias(c)
    due = rows.where("next_due is not null and next_due <> ''").select(*map(text, ("equipment", "standard")), text("inspection_type", "Inspection"), "next_due", *map(text, ("last_inspection", "revision", "doc_id")), "page")
    items = due.select(F.concat_ws(":", F.lit("compliance"), "equipment", "standard", "next_due").alias("id"), "*", due_status(F.col("next_due"), today).alias("status"))
    urgency = F.when(F.col("status") == "overdue", 0).when(F.col("status") == "due_soon", 1).otherwise(2)
    return items.orderBy(urgency, "next_due", "id")


def compliance_alerts(rows: DataFrame, today: str) -> DataFrame:
    """ETL-24: an alert for each overdue one of rows (see ``compliance_items``); its fingerprint is the item's id."""
    due = rows.where((F.col("next_due") < today) & (F.col("next_due") != ""))
    kind = lambda default: F.coalesce(F.nullif("inspection_type", F.lit("")), F.lit(default))
    title = F.trim(F.concat(F.lit("Overdue inspection: "), "equipment", F.lit(" "), kind("")))
    body = F.concat("equipment", F.lit(" - "), kind("inspection"), F.lit(" per "), "standard", F.lit(" was due "), "next_due", F.lit(" and is now overdue."))
    return due.select(F.lit("compliance").alias("kind"), F.lit("warning").alias("severity"), title.alias("title"), body.alias("body"), "equipment", "doc_id", "page", F.concat_ws(":", F.lit("compliance"), "equipment", "standard", "next_due").alias("fingerprint"))


def status_counts(position: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return position.agg(count("overdue"), count("due_soon"), count("compliant"))


def moved_standards(now: DataFrame, before: DataFrame) -> DataFrame:
    """Standards whose revision differs from the stored one (compared as keys); first sight is a baseline."""
    from millrace.functions.rules import revision_key

    j = now.join(before.withColumnRenamed("revision", "known"), "standard", "left")
    changed = F.col("known").isNotNull() & (revision_key(F.col("revision")) != revision_key(F.col("known")))
    return j.select("standard", "revision", F.col("known").isNull().alias("baseline"), changed.alias("moved"))


def eval_summary(results: DataFrame) -> DataFrame:
    """Verdict counts, accuracy, citation hits, mode matches and mean seconds of results."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 2)
    v = F.col("verdict")
    return results.agg(F.count("*").alias("cases"), *(F.count_if(v == x).alias(x) for x in ("correct", "partial", "wrong")), rate(v == "correct").alias("accuracy"), rate(F.col("citation_hit")).alias("citation_hit_rate"), rate(F.col("mode_expected") == F.col("mode_actual")).alias("mode_match_rate"), F.round(F.avg("seconds"), 2).alias("mean_seconds"))


def weighted_by_mode(results: DataFrame) -> DataFrame:
    points = F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "partial", 0.5).otherwise(0.0)
    return results.groupBy("mode_expected").agg(F.count("*").alias("cases"), F.round(F.avg(points), 3).alias("score"))


def first_decisions(events: DataFrame) -> DataFrame:
    """The first decision of each draft wins."""
    return events.groupBy("draft_id").agg(F.min(F.struct("ts", "decision", "who")).alias("m")).select("draft_id", "m.ts", "m.decision", "m.who")


def desired_workers(depths: DataFrame, per_worker: int, least: int, most: int) -> DataFrame:
    """Workers for the backlog of each service: ceil(sum / per_worker) within bounds."""
    need = F.ceil(F.sum("depth") / per_worker)
    return depths.groupBy("service").agg(F.greatest(F.lit(least), F.least(F.lit(most), need)).cast("bigint").alias("workers"))


def hourly(alerts: DataFrame, now: str, hours: int = 12) -> DataFrame:
    """Counts in the hours before ``now``, newest first (bucket 0), zero-filled."""
    spine = alerts.sparkSession.range(hours).withColumnRenamed("id", "bucket")
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    by = alerts.withColumn("bucket", F.floor(age / 3_600_000_000)).where((F.col("bucket") >= 0) & (F.col("bucket") < hours)).groupBy("bucket").agg(F.count("*").alias("n"))
    return spine.join(by, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
