"""Quality rules: hashed n-gram log-likelihood ratios, plus fixed surface rules.

Two multinomials over ``buckets`` hashed word unigrams and bigrams are
estimated, one from trusted (target) documents and one from the raw corpus.  A
document's score is the mean log ratio of its n-grams under the two, so it does
not depend on length; documents scoring below ``threshold`` are rejected.

A mean hides a few bad words in long prose, so a second ratio of the same kind
looks at the strongest n-grams alone: the rate of a hashed word stem (its first
``STEM`` letters) among labelled toxic documents over its rate among all
documents, each counted once a document.  A document's ``toxic_score`` is the
ratio of its second strongest stem, or of its ``words / 300``-th in longer texts,
so length is normalised by rank; documents at ``toxic_threshold`` or above are
rejected.

Only SQL functions are used.  Counting pre-aggregates to at most
``2 * buckets + 1`` rows per task; scoring reads the weights as one
scalar-subquery array of that many doubles, so no document is shuffled and no key
can be hot.

Defined cases: a null text counts as empty; a text without n-grams scores 0.0
and falls to the surface rules; repeated rows are judged alike; an empty table
gives an empty result; with no trusted document every score is 0.0, and with no
toxic one every toxic score is 0.0 or less; an id labelled both ways counts for
both.  Columns of the input are all kept, and working columns never clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Words and runs of symbols: junk differs from prose mostly in its symbols and its letter case.
#: Runs are possessive: nothing follows them, and the matcher keeps no places to go back to.
TOKEN = r"[\p{L}\p{N}]++|[^\p{L}\p{N}\x20\x09-\x0D]++"

#: Letters of a word that its stem keeps, so that inflected forms share a bucket.
STEM = 5


#: Words of the base rules.
WORD = r"[^\x20\x09-\x0D]+"

#: Low bits of a sorted window key that hold its place.
PLACE_BITS = 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def rest_from(items: Column, first: int) -> Column:
    """``items`` from place ``first`` on.  The length stays near the array's: one near 2**31 overflows inside a lambda."""
    return F.slice(items, first, F.size(items))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_hashes(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.xxhash64(t))


def with_next(items: Column, body) -> Column:
    """``body`` of each item and the next one, which is null after the last."""
    return F.zip_with(items, rest_from(items, 2), body)


def stem_bucket(token: Column, buckets: int) -> Column:
    """Stems' buckets follow those of n-grams.  Letter case tells junk from prose, so only the stems' letters are folded."""
    return F.xxhash64(F.lower(F.substring(token, 1, STEM))).bitwiseAND(F.lit(buckets - 1)) + F.lit(buckets)


def hashed_ngrams(toks: Column, buckets: int) -> Column:
    """Buckets of the unigrams and bigrams of ``toks``."""
    mask = F.lit(buckets - 1)

    def grams(hashes: Column) -> Column:
        single = F.transform(hashes, lambda h: h.bitwiseAND(mask))
        # the last token's bigram has the end in it: a null, which the hash passes over
        return F.concat(single, with_next(hashes, lambda h, g: F.xxhash64(h, g).bitwiseAND(mask)))

    return bound(token_hashes(toks), grams)


def ngram_weights(docs: DataFrame, buckets: int, prior: float, gram_count: float, toxic_prior: float, toxic_count: float) -> DataFrame:
    """One row, ``weights``: log p_target - log p_raw of each n-gram bucket, then the log ratio of rates of each stem bucket.

    ``docs``: text, target, toxic (0 or 1).  The target multinomial is mixed with
    the raw one, ``prior`` parts of it to one part of target, so an n-gram the
    trusted set lacks costs the same bounded amount, log(prior / (1 + prior)),
    whatever the size of the corpus; ``gram_count`` is added to its count and to
    the count expected, so what chance leaves out of a small target costs little.
    ``toxic_prior`` and ``toxic_count`` labelled
    documents are added to both rates of a stem, so neither does a rare stem's
    ratio grow with the corpus, nor does chance decide where labels are few.
    """
    stems = lambda toks: F.array_distinct(F.transform(toks, lambda t: stem_bucket(t, buckets)))
    # the last bucket counts documents
    listed = bound(tokens(F.col("text")), lambda toks: F.concat(hashed_ngrams(toks, buckets), stems(toks), F.array(F.lit(2 * buckets).cast("long"))))
    grams = docs.select("target", "toxic", F.explode(listed).alias("bucket")).withColumn("raw", F.lit(1).cast("long"))
    # every bucket gets a row, so that the sorted list below is indexed by bucket
    zero = F.lit(0).cast("long")
    slots = docs.sparkSession.range(2 * buckets + 1).select(F.col("id").alias("bucket"), zero.alias("raw"), zero.alias("target"), zero.alias("toxic"))
    counts = grams.unionByName(slots).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "target", "toxic")])
    word, doc = F.col("bucket") < buckets, F.col("bucket") == 2 * buckets
    # collect_list holds ``2 * buckets + 1`` entries, whatever the corpus
    model = counts.agg(
        F.sum(F.when(word, F.col("raw"))).alias("n_raw"),
        F.sum(F.when(word, F.col("target"))).alias("n_target"),
        F.sum(F.when(doc, F.col("raw"))).alias("n_docs"),
        F.sum(F.when(doc, F.col("toxic"))).alias("n_toxic"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target", "toxic"))).alias("listed"),
    )

    def weight(e: Column) -> Column:
        # counts of the n-gram in the target, and what a share of the raw corpus as large as the target would hold
        share = F.coalesce(e["raw"] / F.col("n_raw") * F.col("n_target"), F.lit(0.0))
        ratio = (e["target"] + gram_count) / (share + gram_count)
        # numbers of toxic documents: those with the stem, and those expected of as many documents of the corpus
        expected, added = e["raw"] / F.col("n_docs") * F.col("n_toxic"), toxic_prior * F.col("n_toxic") + toxic_count
        return (
            F.when(e["raw"] == 0, F.lit(0.0))
            .when(e["bucket"] < buckets, F.log((ratio + prior) / (1 + prior)))
            .otherwise(F.log((e["toxic"] + added) / (expected + added)))
        )

    return model.select(F.transform("listed", weight).alias("weights"))


def repeated_window_words(ws: Column, n: int = 3) -> Column:
    """How many words lie in an ``n``-word window that the text holds twice or more.

    Windows are sorted by hash with their positions; equal neighbours give the
    positions whose windows repeat, and gaps between those give the cover.  To sort
    few, windows are first sorted as one number each, the hash with the position in
    its lowest bits: repeated ones are among those whose other bits agree.
    """
    place = F.lit((1 << PLACE_BITS) - 1).cast("long")

    def joined(hashes: Column) -> Column:
        window = lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, n)])
        # windows past the end are cut off
        return F.slice(F.transform(hashes, window), 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))

    def keyed(windows: Column) -> Column:
        return F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))

    def linked(s: Column, equal, of) -> Column:
        """``of`` each neighbour in the sorted ``s`` to which another is ``equal``."""
        pairs = F.zip_with(s, rest_from(s, 2), lambda a, b: F.when(equal(a, b), F.array(of(a), of(b))))
        return F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))

    def cover(s: Column) -> Column:
        return F.array_sort(linked(s, lambda a, b: a["h"] == b["h"], lambda x: x["p"]))

    def alike(windows: Column) -> Column:
        packed = F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("long")))
        upper = lambda x: F.shiftright(x, PLACE_BITS)
        found = bound(F.sort_array(packed), lambda s: linked(s, lambda a, b: upper(a) == upper(b), lambda x: x.bitwiseAND(place).cast("int")))
        return F.transform(found, lambda p: F.struct(F.get(windows, p).alias("h"), p.alias("p")))

    def span(p: Column) -> Column:
        gaps = F.zip_with(p, rest_from(p, 2), lambda a, b: F.least(F.lit(n), F.coalesce(b - a, F.lit(n))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    candidates = lambda hs: F.when(F.size(hs) <= place, alike(hs)).otherwise(keyed(hs))
    repeats = lambda hs: bound(bound(F.sort_array(candidates(hs)), cover), span)
    # the sort is dear, and most texts repeat no window
    return bound(bound(hashes, joined), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(repeats(hs)))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def surface_stats(text: Column) -> Column:
    """Struct of the counts that the surface rules use."""
    t = F.coalesce(text, F.lit(""))

    def stats(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeated_window_words(ws).alias("n_repeat_words")
        )

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = bound(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
    return F.struct(
        bound(words(text), stats).alias("w"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
    )


def labelled_sample(labels: DataFrame, limit: int) -> DataFrame:
    """(label_id, target, toxic): at most ``limit`` trusted and as many toxic documents, chosen by hash."""

    def some(condition: Column, flag: str) -> DataFrame:
        ids = labels.where(condition & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        return ids.select("doc_id", *[F.lit(int(c == flag)).cast("long").alias(c) for c in ("target", "toxic")])

    good = F.col("quality") == 1
    both = some(good & (F.col("toxic") == 0), "target").unionByName(some(good & (F.col("toxic") == 1), "toxic"))
    return both.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("target").alias("target"), F.max("toxic").alias("toxic"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 16,
    prior: float = 0.2,
    gram_count: float = 5.0,
    threshold: float = -0.25,
    toxic_prior: float = 0.015,
    toxic_count: float = 3.0,
    toxic_threshold: float = 0.65,
    label_limit: int = 20_000,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """``docs`` with one struct column ``quality`` more (n_words, ..., base_failed, score, toxic_score, kept).

    Of labels held out of the fit, junk scores below -0.35 and good text above -0.13
    at 1,000 and at 10,000 documents; ``threshold`` lies between.  ``label_limit`` bounds each labelled sample (and
    the broadcast of its ids); the raw counts always cover every document.
    """
    out = free_name(docs, "quality")
    marked = docs.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, label_limit)), F.col("doc_id") == F.col("label_id"), "left")
    marked = marked.select("text", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("target", "toxic")])
    weights = ngram_weights(marked, buckets, prior, gram_count, toxic_prior, toxic_count).scalar()

    w = free_name(docs, "weights")
    of = lambda bucket: F.col(w)[bucket]

    def both(hashes: Column) -> Column:
        """Weight of each token and its bigram."""
        mask = F.lit(buckets - 1)
        return with_next(hashes, lambda h, g: of(h.bitwiseAND(mask)) + of(F.xxhash64(h, g).bitwiseAND(mask)))

    def scores(toks: Column) -> Column:
        n = F.size(toks)
        mean = F.when(n > 0, F.aggregate(bound(token_hashes(toks), both), F.lit(0.0), lambda acc, x: acc + x) / (2 * n)).otherwise(F.lit(0.0))
        rank = F.greatest(F.lit(2), F.ceil(n / 300).cast("int"))
        # only positive ratios are sorted: there are few
        strong = F.sort_array(F.filter(F.transform(toks, lambda t: of(stem_bucket(t, buckets))), lambda x: x > 0), asc=False)
        return F.struct(mean.alias("score"), bound(strong, lambda s: F.coalesce(F.get(s, rank - 1), F.lit(0.0))).alias("toxic_score"))

    def verdict(x: Column) -> Column:
        s, m = x["surface"], x["model"]
        failed = (s["w"]["n_words"] < min_words) | (100 * s["w"]["n_repeat_words"] > max_repeat_percent * s["w"]["n_words"])
        return F.struct(
            s["w"]["n_words"].alias("n_words"),
            s["w"]["word_chars"].alias("word_chars"),
            s["n_symbols"].alias("n_symbols"),
            s["n_dup_lines"].alias("n_dup_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            m["score"].alias("score"),
            m["toxic_score"].alias("toxic_score"),
            (~failed & (m["score"] >= threshold) & (m["toxic_score"] < toxic_threshold)).alias("kept"),
        )

    # one bound expression, so a filter on the verdict evaluates its parts once
    found = F.struct(surface_stats(F.col("text")).alias("surface"), bound(tokens(F.col("text")), scores).alias("model"))
    return docs.withColumn(w, weights).select(*[F.col(f"`{c}`") for c in docs.columns], bound(found, verdict).alias(out))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` keeps, with the columns of ``docs``."""
    judged = judge(docs, labels, **options)
    return judged.where(F.col(f"{judged.columns[-1]}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
