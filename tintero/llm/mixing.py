"""Problem 9: documents of several sources mixed to target shares of tokens.

Method: pivotal dependent rounding.  Every document of a source has the same
expected number of copies, what the target share needs divided by what the
source holds, at most its cap.  What a capped source cannot give is handed on to the
others in proportion to their shares, until the mix has its size or every source
is at its cap.  The fractional parts are made integral by pairing documents and
randomly moving mass from one to the other until one of them is 0 or 1, first
within buckets of a source, then over the buckets' residuals in a reduction
tree, so that the number of copies of each source is within one of its
expectation; documents of like size are paired, so that tokens are nearly kept
too.  All randomness is a hash of document ids, hence a lost task gives the same
result again.
"""

from __future__ import annotations

import base64
import math
import os

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintero.llm.arrow import flat_map
from tintero.runtime import checkpoint, hand_over

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TINTERO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Documents of a source in one bucket of the first level, about; residuals merged in one group of the tree.
BUCKET = 20_000
FAN_IN = 64
SEED = 17
# Fixed value: the pattern that cuts text before byte-level BPE, as published with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id, source, tokens): source trimmed and lower-cased; null text has 0 tokens; rows without a source are left out."""
    kind, path = dict(docs.dtypes)[id_col], os.path.join(folder, VOCABULARY)

    def run(rows):
        enc = _encoding(path)
        for i, s, t in rows:
            yield i, s, len(enc.encode_ordinary(t)) if t else 0

    src = F.lower(F.trim("source"))
    return flat_map(docs.select(id_col, src.alias("source"), text_col).where(F.col("source").isNotNull() & (F.col("source") != "")), run, f"`{id_col}` {kind}, source string, tokens bigint")


def plan(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Per weighted source: documents, tokens, what its share of the mix wants, and the expected copies per document.

    The mix is as large as all documents with a source together
    (``size_tokens``); ``wanted_tokens`` is the target share of it.  Where a
    source cannot give that with every document at its cap, it gives all it can
    and the rest is handed on in proportion to the shares: the expected tokens
    are the lesser of the cap and one common level times the share.  A cap that
    is null does not bind.
    """
    held = counts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))
    total = held.agg(F.sum("tokens")).first()[0] or 0
    w = weights.where("source IS NOT NULL").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.min("source").alias("spelled"), F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    j = w.join(held, "source", "left").select("source", "spelled", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    j = checkpoint(j.withColumn("size_tokens", F.lit(total)).withColumn("wanted_tokens", F.col("target_share") * F.lit(total)))
    full = F.coalesce(F.col("tokens") * F.greatest("max_repeats", F.lit(0)), F.when(F.col("tokens") > 0, F.lit(float("inf"))).otherwise(0.0))
    size, bound, level = total * (j.agg(F.sum("target_share")).first()[0] or 0.0), -1, 0.0
    while True:
        # Sources under the level are at their cap; the level of the others rises by what is missing, until no further one is.
        r = j.agg(F.coalesce(F.sum(F.when(full < level * F.col("target_share"), full)), F.lit(0.0)).alias("given"), F.coalesce(F.sum(F.when(full >= level * F.col("target_share"), F.col("target_share"))), F.lit(0.0)).alias("open"), F.count_if(full < level * F.col("target_share")).alias("capped")).first()
        if r["capped"] == bound or r["open"] <= 0:
            break
        bound, level = r["capped"], (size - r["given"]) / r["open"]
    copies = F.when(F.col("tokens") > 0, F.least(F.lit(level) * F.col("target_share"), full) / F.col("tokens")).otherwise(0.0)
    return j.withColumn("copies_expected", copies)


def _uniform(*key) -> float:
    return xxhash.xxh3_64_intdigest(repr(key).encode(), seed=SEED) / 2**64


def pivot_round(units: list[tuple]) -> tuple[list[tuple], tuple | None]:
    """Pairs (id, probability) one after the other; returns the decided (id, 0 or 1) and the residual, if any."""
    done, left = [], None
    for i, p in units:
        if p <= 1e-9 or p >= 1 - 1e-9:
            done.append((i, int(p > 0.5)))
            continue
        if left is None:
            left = (i, p)
            continue
        j, q = left
        u = _uniform(i, j)
        if p + q < 1:  # one of them falls to 0
            keep_j = u * (p + q) < q
            done.append((i, 0) if keep_j else (j, 0))
            left = (j, p + q) if keep_j else (i, p + q)
        else:  # one of them rises to 1
            up_j = u * (2 - p - q) < 1 - p
            done.append((j, 1) if up_j else (i, 1))
            left = (i, p + q - 1) if up_j else (j, p + q - 1)
        if left[1] <= 1e-9 or left[1] >= 1 - 1e-9:
            done.append((left[0], int(left[1] > 0.5)))
            left = None
    return done, left


def mix(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id, source, tokens, copies) of every document of a weighted source."""
    counts = checkpoint(token_counts(docs, id_col, text_col, folder))
    return _rounded(counts, checkpoint(plan(counts, weights)), id_col)


def _rounded(counts: DataFrame, chosen: DataFrame, id_col: str) -> DataFrame:
    kind = dict(counts.dtypes)[id_col]
    top = chosen.agg(F.max("n_docs")).first()[0] or 0
    buckets = max(1, math.ceil(top / BUCKET))
    base = counts.join(hand_over(chosen.select("source", "copies_expected")), "source")
    base = base.select(id_col, "source", "tokens", F.floor("copies_expected").cast("int").alias("whole"), (F.col("copies_expected") - F.floor("copies_expected")).alias("p"))
    level = base.select("source", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int").alias("bucket"), F.col(id_col).alias("id"), "tokens", "p").where("p > 0")

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["tokens", "id"])
        size = dict(zip(pdf["id"].tolist(), pdf["tokens"].tolist()))
        done, left = pivot_round(list(zip(pdf["id"].tolist(), pdf["p"].tolist())))
        rows = [(key[0], key[1], i, size[i], float(v), True) for i, v in done] + ([(key[0], key[1], left[0], size[left[0]], left[1], False)] if left else [])
        return pd.DataFrame(rows, columns=["source", "bucket", "id", "tokens", "p", "done"])

    schema = f"source string, bucket int, id {kind}, tokens bigint, p double, done boolean"
    decided = None
    while True:
        out = checkpoint(level.groupBy("source", "bucket").applyInPandas(run, schema))
        part = out.where("done").select("source", "id", F.col("p").cast("int").alias("extra"))
        decided = part if decided is None else decided.unionByName(part)
        rest = out.where("NOT done")
        if buckets == 1:
            # The residual of a source is the fraction of one copy: it is rounded by its probability.
            tail = rest.select("source", "id", (F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_003)) / 1_000_003 < F.col("p")).cast("int").alias("extra"))
            decided = decided.unionByName(tail)
            break
        buckets = math.ceil(buckets / FAN_IN)
        level = rest.select("source", (F.col("bucket") % buckets).cast("int").alias("bucket"), "id", "tokens", "p")
    ex = decided.select(F.col("source").alias("_s"), F.col("id").alias("_i"), "extra")
    j = base.join(ex, (F.col("source") == F.col("_s")) & (F.col(id_col) == F.col("_i")), "left")
    return j.select(id_col, "source", "tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))


def _report(docs: DataFrame, weights: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """The plan's rows with what the mix itself uses: tokens, copies, and the fewest copies of a document."""
    counts = checkpoint(token_counts(docs, id_col, text_col, folder))
    chosen = checkpoint(plan(counts, weights))
    used = _rounded(counts, chosen, id_col).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("copies"), F.min("copies").alias("fewest"))
    j = chosen.join(used, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("used_tokens", "copies")})
    # Short: every document stands in the mix as often as it may, and the source is still under its share.
    short = (F.coalesce(F.col("fewest") >= F.col("max_repeats"), F.col("n_docs") == 0)) & (F.col("used_tokens") < F.col("wanted_tokens"))
    return j.withColumn("short", short)


def shares(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Report per weighted source, all of it measured on the mix.

    target_share; share_of_size (used tokens by the size the mix was to have)
    and actual_share (by the size it has); documents, tokens held and used,
    copies, and whether the source falls short of its target share.
    """
    j = checkpoint(_report(docs, weights, id_col, text_col, folder))
    total = j.agg(F.sum("used_tokens")).first()[0] or 0
    of = lambda n: F.col("used_tokens") / F.greatest(n, F.lit(1))
    return j.select(F.col("spelled").alias("source"), "target_share", of(F.col("size_tokens")).alias("share_of_size"), of(F.lit(total)).alias("actual_share"), "n_docs", "tokens", "used_tokens", "copies", "short")


def short_sources(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(source, as spelled in the weights) of sources that cannot fill their share, read off the mix itself.

    A source of the weights without documents is short unless its share is 0.
    """
    return _report(docs, weights, id_col, text_col, folder).where("short").select(F.col("spelled").alias("source"))
