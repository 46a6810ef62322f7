"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its five-word shingles (lower case; a shorter text is one term), weighted by how often each occurs. For
each of ``SAMPLES`` samples and each term, hashes of the term give uniform numbers and from them r and c, both of the
gamma distribution of shape 2, and b, uniform. With t = floor(ln(weight) / r + b) the sample takes the term that makes
ln c - r (t - b) - r least. Two texts take the same term at the same t with a probability equal to the generalised
Jaccard similarity of their weights, so the share of equal samples estimates it. The least value itself stands for
(term, t): it is a function of the two.

Documents are dealt once, by ranges of doc_id, so that a document and the next one meet in one task; the first document
of each range is also sent to the range before it. Terms are built, counted and sampled within the row's task.

Defined results: a null or empty text has no terms and the fingerprint of no terms, whose likeness to itself is 1 and to
others 0; equal doc_ids are ordered by a hash of the text, null ids come last; of repeated rows each is the next one's
neighbour; a single document is its own next document; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE, SAMPLES = 5, 16
#: Characters of text meant for one range of doc_id, and quantiles of doc_id that the driver gets at most.
RANGE_CHARS, QUANTILES = 4 << 20, 64


def terms(text: Column) -> Column:
    """Hashes of the text's words; apply ``shingles`` to a column that holds them."""
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: str) -> Column:
    """Sorted hashes of the shingles of a column of word hashes."""
    w, n = F.col(words), F.size(words)
    whole = F.when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    many = F.transform(F.slice(w, 1, F.greatest(n - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, SHINGLE))))
    return F.sort_array(F.when(n >= SHINGLE, many).otherwise(whole))


def _uniform(term: str, k: int) -> str:
    """SQL for a number strictly between 0 and 1, the k-th that belongs to a term."""
    return f"((shiftrightunsigned(xxhash64({term} ^ {0x9E3779B97F4A7C15 * (k + 1) % (1 << 63)}L), 11) + 0.5D) * {2.0**-53!r}D)"


def sample(term: str, log_weight: str, k: int) -> str:
    """SQL for the k-th sample's value at a term: ln c - r (t - b) - r."""
    u = [_uniform(term, 5 * k + j) for j in range(5)]
    r, log_c, b = f"(-ln({u[0]} * {u[1]}))", f"ln(-ln({u[2]} * {u[3]}))", u[4]
    # One expression for all weights: equal t must give equal doubles, as the value stands for (term, t).
    return f"{log_c} - {r} * (floor({log_weight} / {r} + {b}) - {b}) - {r}"


def _ranged(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with a range number that does not fall as doc_id rises, and each range's first row also in the range before."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    pair = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    size = pair.agg(F.sum(F.length("text").cast("long")).alias("n"), F.percentile_approx("doc_id", [k / QUANTILES for k in range(QUANTILES + 1)], 10000).alias("q")).first()
    points = sorted(set(size["q"] or [0]))
    cuts, parts = points[1:-1], max(1, -(-(size["n"] or 0) // (RANGE_CHARS * QUANTILES)))
    among = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    lows, highs = F.array(*map(F.lit, points[:1] + cuts)), F.array(*map(F.lit, cuts + points[-1:]))
    spread = (F.col("doc_id") - F.get(lows, F.col("among"))) / (F.get(highs, F.col("among")) - F.get(lows, F.col("among")) + F.lit(1.0)) * F.lit(float(parts))
    number = F.col("among").cast("long") * parts + F.least(F.greatest(F.floor(spread), F.lit(0)), F.lit(parts - 1))
    rows = pair.withColumn("among", among).withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(number)).drop("among").withColumn("tie", F.xxhash64("text"))
    # Ranges follow each other from the highest doc_id down; after the last comes the first again. One short row each.
    firsts = rows.groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    down = W.orderBy(F.col("range").desc())
    before = F.coalesce(F.lag("range").over(down), F.min("range").over(W.partitionBy()))
    heads = firsts.withColumn("to", before).select("to", F.col("head.doc_id").alias("head_id"), F.col("head.tie").alias("head_tie"))
    guests = rows.join(heads, rows.doc_id.eqNullSafe(heads.head_id) & (rows.tie == heads.head_tie)).select(F.col("to").alias("range"), "doc_id", "text", "tie", F.lit(1).alias("guest"))
    return rows.select("range", "doc_id", "text", "tie", F.lit(0).alias("guest")).unionByName(guests)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 3) characters replaced by as many first characters of the
    next document (descending doc_id, the first after the last).
    """
    order = W.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    placed = _ranged(docs, doc_id, text).withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    both = placed.select("range", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("which", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumn("words", terms(F.when(F.col("which") == 0, F.col("text")).otherwise(F.col("edited")))).drop("text", "edited")
    sorted_terms = both.withColumn("terms", shingles("words")).drop("words")
    t = F.col("terms")
    starts = F.filter(F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(t, i - 1) != F.get(t, i)))
    runs = sorted_terms.withColumn("starts", starts)
    s = F.col("starts")
    weighted = F.transform(s, lambda p, j: F.struct(F.get(t, p).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(t)) - p).alias("weight")))
    keys = ["range", "place", "guest", "doc_id", "n_chars", "edited_sha256", "which"]
    each = runs.select(*keys, F.explode_outer(weighted).alias("x")).select(*keys, F.col("x.term").alias("term"), F.ln(F.col("x.weight").cast("double")).alias("log_weight"))
    least = each.groupBy(*keys).agg(*(F.min(F.expr(sample("term", "log_weight", k))).alias(f"s{k}") for k in range(SAMPLES)))
    code = F.concat(*(F.substring(F.lpad(F.lower(F.hex(F.xxhash64(F.coalesce(f"s{k}", F.lit(0.0)), F.lit(k)))), 16, "0"), 1, 8) for k in range(SAMPLES)))
    coded = least.withColumn("code", code)
    own = ["range", "place", "guest", "doc_id", "n_chars", "edited_sha256"]
    pair = coded.groupBy(*own).agg(F.max(F.when(F.col("which") == 0, F.col("code"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("code"))).alias("edited_fingerprint"))
    done = pair.withColumn("next_fingerprint", F.lead("fingerprint").over(W.partitionBy("range").orderBy("place"))).where("guest = 0")
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two fingerprints, 0 to 1."""
    same = (F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8) for k in range(SAMPLES))
    return sum((x.cast("int") for x in same), F.lit(0)) / F.lit(float(SAMPLES))
