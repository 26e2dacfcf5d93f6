"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio. DataFrame functions only.

Two models of character pairs, one of random strings and one of ordinary identifiers, are counted from labelled samples. A maximal
run of token characters that is long enough and holds a letter and a digit is a secret if the first model explains it so much
better than the second that the log-likelihood ratio passes a margin.

One regular-expression test a text finds the few that can hold anything; only those are cut into spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropmill.llm.arrays import bound, running

#: Kinds of spans, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "markov")
# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Characters of the models; candidates are runs of them.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN_LEAST = 20
#: A maximal run of at least TOKEN_LEAST model characters, with a digit and a letter.
TOKEN = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}"
#: Whatever holds a span holds one of these.
ANY = rf"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-])|{TOKEN}|[0-9a-f]{{{HEX_LEAST}}}|AKIA[A-Z0-9]{{{ACCESS_LEAST - 4}}}"""
#: Places in code points, end exclusive, and the same in bytes of UTF-8.
SPAN = "array<struct<start:int,kind:int,end:int,byte_start:int,byte_end:int>>"


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2_000, random_rows: int = 4_000) -> DataFrame:
    """``(token, secret)``: random strings of four alphabets, and identifiers made of the words of ``sample_docs`` documents.

    The documents are those whose ids' hashes are smallest; words are runs of letters, and neighbouring words are joined as identifiers are.
    """
    spark = docs.sparkSession
    raw = spark.range(random_rows).select(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    made = raw.select(F.explode(F.array(F.substring("h", 1, 40), b64, F.translate(F.upper(b64), "+/=", ""), F.translate(b64, "+/=", "-_"))).alias("token"), F.lit(1).alias("secret"))
    chosen = docs.select(F.col(id_col).alias("key")).where("key is not null").orderBy(F.xxhash64("key"), "key").limit(sample_docs).distinct()
    words = F.filter(F.split(F.col(text_col).cast("string"), "[^A-Za-z]+", -1), lambda w: F.length(w) > 1)
    texts = docs.select(F.col(id_col).alias("key"), words.alias("w")).join(F.broadcast(chosen), "key", "left_semi")
    at = texts.select(F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("i", "p")).select("i", F.col("p.a").alias("a"), F.col("p.b").alias("b")).where("b is not null")
    names = F.when(F.col("i") % 4 == 0, F.concat("a", F.lit("_"), "b")).when(F.col("i") % 4 == 1, F.concat("a", F.initcap("b"))).when(F.col("i") % 4 == 2, F.concat("a", F.lit("-"), "b", F.lit("-"), F.col("i").cast("string"))).otherwise(F.concat("a", F.lit("/"), "b", F.lit("_"), (F.col("i") * 37 % 2100).cast("string")))
    return made.unionByName(at.select(names.alias("token"), F.lit(0).alias("secret")))


def train(samples: DataFrame, token: str = "token", secret: str = "secret", prior: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character pairs (random over ordinary), ``prior`` added to each count.

    Only counts of pairs of model characters reach the driver, two for each at most. Null tokens and labels are left out, and so are
    pairs with other characters.
    """
    n = len(LETTERS)
    rows = samples.where(f"{token} is not null and length({token}) > 1 and {secret} is not null")
    pairs = rows.select(F.col(secret).cast("boolean").alias("s"), F.explode(F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.col(token).substr(i, F.lit(2)))).alias("p"))
    counts = [[prior] * (n * n), [prior] * (n * n)]
    for row in pairs.groupBy("s", "p").count().where(F.col("p").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect():
        counts[int(row.s)][LETTERS.index(row.p[0]) * n + LETTERS.index(row.p[1])] += row["count"]
    out = []
    for p in range(n * n):
        share = [counts[k][p] / sum(counts[k][p - p % n : p - p % n + n]) for k in (0, 1)]
        out.append(math.log(share[1] / share[0]))
    return out


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, over its pairs of model characters."""
    table, n = F.lit(model), len(LETTERS)
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(LETTERS), c) - 1)

    def total(at: Column) -> Column:
        def score(i: Column) -> Column:
            a, b = F.get(at, i), F.get(at, i + 1)
            return F.when((a >= 0) & (b >= 0), F.get(table, a * n + b)).otherwise(F.lit(0.0))

        return F.aggregate(F.filter(F.transform(at, lambda _, i: i), lambda i: i + 1 < F.size(at)), F.lit(0.0), lambda acc, i: acc + score(i))

    return bound(places, total)


def located(text: Column, pattern: str, kind: str, group: int = 0, test=None) -> Column:
    """Spans of the leftmost non-overlapping matches of ``pattern`` whose ``group`` passes ``test``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), held.alias("held"))
    k = KINDS.index(kind)

    def spans(parts: Column) -> Column:
        sizes = F.transform(parts, lambda x: F.struct((F.length(x["gap"]) + F.length(x["hit"])).alias("chars"), (F.octet_length(x["gap"]) + F.octet_length(x["hit"])).alias("bytes")))
        ends = running(sizes, lambda a, b: F.struct((a["chars"] + b["chars"]).alias("chars"), (a["bytes"] + b["bytes"]).alias("bytes")))
        own = F.filter(F.arrays_zip(parts.alias("part"), ends.alias("end")), lambda x: test(x["part"]["held"]))

        def span(x: Column) -> Column:
            hit, end = x["part"]["hit"], x["end"]
            return F.struct((end["chars"] - F.length(hit)).alias("start"), F.lit(k).alias("kind"), end["chars"].alias("end"), (end["bytes"] - F.octet_length(hit)).alias("byte_start"), end["bytes"].alias("byte_end"))

        return F.transform(own, span)

    return F.when(F.size(hits) > 0, bound(zipped, spans)).otherwise(F.array().cast(SPAN))


def secret_spans(docs: DataFrame, model: list[float], text_col: str = "text", out: str = "secrets", margin: float = 12.0) -> DataFrame:
    """All columns of ``docs`` and ``out``: an array of (start, kind, end, byte_start, byte_end), kinds numbered as in ``KINDS``, sorted.

    Base kinds are always listed; a Markov span is listed where its ratio is at least ``margin`` and no base span covers all of it.
    Null and empty texts have no spans. A column named ``out`` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast(SPAN)
    flagged = docs.withColumn(out, F.when(text.rlike(ANY), text))
    t = F.col(out)
    base = [located(t, ASSIGN, "assign", group=2, test=lambda x: F.length(x) >= ASSIGN_LEAST), located(t, ACCESS, "access", test=lambda x: F.length(x) >= ACCESS_LEAST), located(t, rf"{HEX[:-1]}{{{HEX_LEAST},}}", "hex", test=lambda x: F.lit(True))]
    found = located(t, TOKEN, "markov", test=lambda x: likelihood_ratio(x, model) >= margin)

    def uncovered(spans: Column) -> Column:
        """Base spans sort before others of their start, so those that can cover a span stand before it."""
        reach = running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), F.greatest)
        return F.transform(F.filter(F.arrays_zip(spans.alias("span"), reach.alias("reach")), lambda x: (x["span"]["kind"] < 3) | (x["reach"] < x["span"]["end"])), lambda x: x["span"])

    return flagged.withColumn(out, F.when(t.isNotNull(), bound(F.array_sort(F.concat(*base, found)), uncovered)).otherwise(none))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal run of spans replaced by ``mark``; spans must be sorted."""

    def cut(x: Column) -> Column:
        own, reach, body = x["spans"], x["reach"], x["body"]
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
        heads = F.filter(F.transform(own, lambda _, i: i), lambda i: (i == 0) | (F.get(own, i)["byte_start"] > before(i)))
        kept = F.transform(heads, lambda i: F.substring(body, before(i) + 1, F.get(own, i)["byte_start"] - before(i)).cast("string"))
        tail = F.substring(body, F.array_max(reach) + 1, F.octet_length(body)).cast("string")
        return F.concat(F.array_join(kept, mark), F.lit(mark), tail)

    whole = F.struct(spans.alias("spans"), running(F.transform(spans, lambda s: s["byte_end"]), F.greatest).alias("reach"), text.cast("binary").alias("body"))
    return F.when(F.size(spans) > 0, bound(whole, cut)).otherwise(text)
