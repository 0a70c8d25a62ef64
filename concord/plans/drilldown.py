"""Agreement of two sides by a tree of digests, so that rows that agree are never moved.

Rows fall into 2^bits buckets by the leading bits of a hash of their key. A bucket's digest is the number of its rows, and the sums and the
exclusive or of two 64-bit hashes of key and record hash: a few numbers that each task adds up first. Trees of two sides can be made
at different times or places; they are compared from the top, one level of `FAN` bits after the other, each time only under
the buckets that differ. The rows of the leaves that differ are then looked at, those of the others are known to agree.

Two buckets of different rows have equal digests only if several 64-bit sums collide at once. A NULL key has no partner and is in no bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.domain import Domain
from concord.functions import verdict
from concord.operators.align import HOT_ROWS, align, has_null_key, key_tally, one_sided
from concord.operators.hashview import Prepared, prepare
from concord.plans import contracts
from concord.plans.reconcile import stored_copy
from concord.plans.summary import count_statuses

#: Bits of the leaves' numbers, and bits by which a level is finer than the one above.
BITS = 16
FAN = 4
DIGEST = ("rows", "no_hash", "low_1", "high_1", "low_2", "high_2", "mixed")


def bucket(keys: list[str], bits: int = BITS) -> Column:
    """The leaf of a key."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)


def leaves(side: DataFrame, keys: list[str], hash_column: str, bits: int = BITS) -> DataFrame:
    """One row per leaf that has rows: (bucket, rows, sums, exclusive or). Each hash is added up in two halves of 32 bits, which
    leaves room for 2^31 rows in a bucket."""
    if not 0 < bits <= 32 or bits % FAN:
        raise ValueError(f"bits must be a multiple of {FAN} up to 32")
    one, two = F.xxhash64(*keys, hash_column), F.xxhash64(F.lit("second"), hash_column, *keys)
    low, high = (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))), (lambda h: F.shiftrightunsigned(h, 32))
    missing = F.col(hash_column).isNull().cast("bigint")
    hashed = side.where(~has_null_key(keys)).select(bucket(keys, bits).alias("bucket"), missing.alias("missing"), one.alias("one"), two.alias("two"))
    sums = [F.sum(part(F.col(h))).alias(f"{name}_{i}") for i, h in ((1, "one"), (2, "two")) for name, part in (("low", low), ("high", high))]
    return hashed.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("missing").alias("no_hash"), *sums, F.bit_xor("one").alias("mixed"))


def differing(source: DataFrame, target: DataFrame, bits: int = BITS) -> DataFrame:
    """Leaves whose digests differ, found from the top of both trees down. A row without hash matches none, so its leaf differs too."""

    def level(side: DataFrame, shift: int, above: DataFrame | None) -> DataFrame:
        own = F.shiftrightunsigned(F.col("bucket"), shift)
        rows = side.withColumn("bucket", own)
        if above is not None:
            rows = rows.withColumn("above", F.shiftrightunsigned(F.col("bucket"), FAN)).join(above, "above", "left_semi")
        # Sums of sums may pass 64 bits; only their equality counts.
        sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in DIGEST if c != "mixed"]
        return rows.groupBy("bucket").agg(*sums, F.bit_xor("mixed").alias("mixed"))

    above = None
    for shift in range(bits - FAN, -1, -FAN):
        s, t = level(source, shift, above), level(target, shift, above)
        same = F.lit(True)
        for c in DIGEST:
            same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
        met = s.alias("s").join(t.alias("t"), F.col("s.bucket") == F.col("t.bucket"), "full_outer")
        odd = met.where(~same | (F.col("s.no_hash") > 0)).select(F.coalesce("s.bucket", "t.bucket").alias("bucket"))
        above = odd.withColumnRenamed("bucket", "above")
    return odd


@dataclass(frozen=True)
class Drilldown:
    """What two sides disagree on. `leaves` are the stored digests of the source, `odd` the stored numbers of the leaves that differ."""

    domain: Domain
    prepared: Prepared
    leaves: DataFrame
    odd: DataFrame
    bits: int
    unique_keys: bool
    hot_rows: int | None

    def _in(self, side: DataFrame, how: str) -> DataFrame:
        keyed = side.where(~has_null_key(self.prepared.keys)).withColumn("bucket", bucket(self.prepared.keys, self.bits))
        return keyed.join(self.odd, "bucket", how).drop("bucket")

    @property
    def suspects(self) -> Prepared:
        """Keys and hashes of the rows that may disagree: those of the leaves that differ, and those with a NULL key."""
        p = self.prepared.thin()
        return replace(p, source=self._in(p.source, "left_semi"), target=self._in(p.target, "left_semi"))

    def _agreeing(self) -> DataFrame:
        """Per key of the agreeing leaves, from one side alone as the other is its equal: rows, hashes, and pairs of equal hashes."""
        keys = self.prepared.keys
        p = self.prepared.thin()
        per_hash = self._in(p.source, "left_anti").groupBy(*keys, "src_hash").agg(F.count("*").alias("n"))
        return per_hash.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count("*").alias("hashes"), F.sum(F.col("n") * F.col("n")).alias("matched"))

    @property
    def match_counts(self) -> DataFrame:
        """One row of totals, status counts and match percentage, as `Result.match_counts` has it. Where keys may repeat, the keys and
        hashes of one side's agreeing rows are counted; where they are unique, the digests say it all."""
        p = self.suspects
        null_key = has_null_key(p.keys)
        thin = self.prepared.thin()
        counted = key_tally(replace(p, source=p.source.unionAll(thin.source.where(null_key)), target=p.target.unionAll(thin.target.where(null_key))))
        if self.unique_keys:
            agreed = self.leaves.join(self.odd, "bucket", "left_anti").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
            matched = F.col("rows")
        else:
            agreed = self._agreeing()
            matched = F.col("matched")
        n = F.col("rows")
        pairs = n if self.unique_keys else n * n
        none = F.lit(0).cast("bigint")
        same = agreed.select(
            n.alias("source_rows"), n.alias("target_rows"), matched.alias("matched"), (pairs - matched).alias("mismatched"),
            none.alias("source_only"), none.alias("target_only"),
        )
        return count_statuses(counted.select(*same.columns).unionAll(same), self.domain)

    @property
    def statuses(self) -> DataFrame:
        """Keys, hashes and status of every pair and one-sided row that does not match."""
        p = self.suspects
        if not self.unique_keys:
            # A key with several hashes has pairs that differ although both sides hold the same.
            several = self._agreeing().where("hashes > 1").select(*p.keys)
            s, t = (self._in(side, "left_anti").join(several, p.keys, "left_semi").select(*side.columns) for side in (self.prepared.thin().source, self.prepared.thin().target))
            p = replace(p, source=p.source.select(*s.columns).unionAll(s), target=p.target.select(*t.columns).unionAll(t))
        rows = align(p, self.hot_rows).where(F.col("status") != verdict.MATCH)
        return rows.select(*p.keys, "src_hash", "tgt_hash", "status", "copies")

    @property
    def one_sided(self) -> tuple[DataFrame, DataFrame]:
        """Keys and hashes of the rows without partner: (source only, target only)."""
        return one_sided(self.suspects)


def drilldown(
    source: DataFrame,
    target: DataFrame,
    domain: Domain,
    *,
    bits: int = BITS,
    unique_keys: bool = False,
    use_hash_column: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> Drilldown:
    """Compare the sides' digests; two jobs read keys and hashes of each side where they lie and write a row per leaf.

    2^bits leaves suit sides of which many leaves agree: some ten times as many as there are differing rows. `unique_keys` is the
    caller's word that no key repeats on the source (see `contracts.key_audit`); then agreeing rows are not read again.
    """
    contracts.require(source, target, domain, use_hash_column)
    p = prepare(source, target, domain, use_hash_column)
    thin = p.thin()
    trees = [stored_copy(leaves(side, p.keys, h, bits), "digests") for side, h in ((thin.source, "src_hash"), (thin.target, "tgt_hash"))]
    odd = stored_copy(differing(*trees, bits), "odd-buckets")
    return Drilldown(domain, p, trees[0], odd, bits, unique_keys, hot_rows)
