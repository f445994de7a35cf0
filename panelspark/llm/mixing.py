"""Mixing sources to temperature weights, as DataFrame functions only.

Source shares p of the tokens become weights q proportional to p^a. The exponent
a between 0 (all sources alike) and 1 (as they are) is bisected to meet a target
entropy of q, or a limit on how often any source repeats. Weights turn into
whole documents by block permutations: a source's documents are dealt into
blocks by hash; a source that is to be read f times and a part takes f whole
epochs, and of a last epoch the first blocks of a seeded permutation, up to the
budget, the block at the border document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import hot_keys, joined_by, saved

#: Each pass splits the bracket into so many parts: six bisections at once, eight passes give 48 bits.
PARTS = 64
PASSES = 8
#: Tokens of a block, about. A border block is ordered by one task.
BLOCK_TOKENS = 1_000_000
#: A table of one row a source is broadcast only up to this count.
BROADCAST_SOURCES = 100_000
#: A token is a run of characters other than ASCII white space.
TOKEN = "[^ \\t\\n\\x0B\\f\\r]+"


def token_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_ratio: float = 1.0) -> float:
    """The exponent for shares (p double, tokens share of each source).

    target_entropy (nats): the exponent whose weights have this entropy; the end
    of [0, 1] that comes nearest if none has. max_repeats: the least exponent
    under which no source is read more than so many times, with a budget of
    budget_ratio times all tokens; a ValueError if that is below budget_ratio,
    as no weights can read every source less often than the whole is read. Only
    aggregates reach the driver.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    if max_repeats is not None and max_repeats < budget_ratio:
        raise ValueError(f"no weights keep every source to {max_repeats} readings of a budget of {budget_ratio} times all tokens")
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = F.explode(F.array(*[F.lit(low + (high - low) * i / PARTS) for i in range(PARTS + 1)])).alias("a")
        raised = shares.select("p", F.ln("p").alias("log_p"), grid).withColumn("w", F.exp(F.col("a") * F.col("log_p")))
        # q = w / z; entropy = ln z - sum(w ln w) / z; repeats = q * ratio / p.
        of = raised.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("a") * F.col("log_p")).alias("wl"), F.max(F.col("w") / F.col("p")).alias("wp"))
        if target_entropy is not None:
            unmet = F.ln("z") - F.col("wl") / F.col("z") > target_entropy
        else:
            unmet = F.col("wp") / F.col("z") * budget_ratio > max_repeats
        found = of.where(unmet).agg(F.max("a")).first()[0]
        if found is None:
            return low
        step = (high - low) / PARTS
        low, high = found, min(found + step, high)
    return high


def mix_sources(
    docs: DataFrame,
    max_repeats: float | None = 1.25,
    target_entropy: float | None = None,
    budget_ratio: float = 1.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The columns of docs, and mix_epoch_ int: a row for each reading of a document.

    The budget is budget_ratio times all tokens. Of each source, whole documents
    are taken while its share of the budget, rounded to tokens, is not exceeded.
    A null source counts as the source '<null>', a null text as no tokens; a
    source without tokens is read once. Rows that share id and source are taken
    or left together. An empty table gives no rows. The result holds columns by
    their place: names may clash with any used here.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}_" for i in range(len(names))])
    ident, text, source = (F.col(f"c{names.index(c)}_") for c in (id_col, text_col, source_col))
    key = F.coalesce(ident.cast("string"), F.lit("<null>"))
    sized = own.withColumns({"source_": F.coalesce(source.cast("string"), F.lit("<null>")), "hash_": F.md5(F.concat(F.lit(f"{seed}|"), key)), "key_": key})
    counted = sized.select("source_", "hash_", "key_", token_count(f"c{names.index(text_col)}_").alias("n_"))
    per_source = saved(counted.groupBy("source_").agg(F.sum("n_").alias("tokens_"), F.count("*").alias("rows_")))
    total = per_source.agg(F.sum("tokens_")).first()[0] or 0
    if not total:
        return own.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(names)], F.lit(0).alias("mix_epoch_"))
    shares = per_source.where(F.col("tokens_") > 0).select((F.col("tokens_") / F.lit(total)).alias("p"))
    a = exponent(shares, target_entropy, max_repeats, budget_ratio)
    powers = per_source.withColumn("w_", F.when(F.col("tokens_") > 0, F.pow(F.col("tokens_") / F.lit(total), F.lit(a))).otherwise(0.0))
    z = powers.agg(F.sum("w_")).first()[0]
    quota = powers.withColumn("quota_", F.round(F.col("w_") / F.lit(z) * F.lit(total * budget_ratio)).cast("long"))
    plan = quota.select(
        "source_",
        F.when(F.col("tokens_") > 0, F.floor(F.col("quota_") / F.greatest("tokens_", F.lit(1))).cast("int")).otherwise(1).alias("full_"),
        F.when(F.col("tokens_") > 0, F.col("quota_") % F.greatest("tokens_", F.lit(1))).otherwise(0).alias("rest_"),
        F.ceil(F.greatest("tokens_", F.lit(1)) / block_tokens).cast("long").alias("blocks_"),
    )
    plan = saved(plan)
    small, hot = plan.count() <= BROADCAST_SOURCES, saved(hot_keys(per_source, "source_", "rows_"))

    def of_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """rows with what is known of their sources; beyond BROADCAST_SOURCES of them, only large sources are dealt apart."""
        return rows.join(F.broadcast(facts), "source_") if small else joined_by(rows, facts, "source_", hot=hot)

    def dealt(df: DataFrame) -> DataFrame:
        """Block of each document, and the block's place in the permutation of the last, partial epoch."""
        number = F.conv(F.substring("hash_", 1, 8), 16, 10).cast("long")
        with_block = df.withColumn("block_", F.pmod(number, F.col("blocks_")))
        turn = F.md5(F.concat_ws("|", F.lit(seed), "source_", F.col("full_").cast("string"), F.col("block_").cast("string")))
        return with_block.withColumns({"turn_": turn, "doc_turn_": F.md5(F.concat_ws("|", F.lit(seed), F.col("full_").cast("string"), "key_"))})

    placed = dealt(of_source(counted, plan))
    blocks = placed.groupBy("source_", "turn_", "block_", "rest_").agg(F.sum("n_").alias("n_"))
    order = Window.partitionBy("source_").orderBy("turn_", "block_").rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumn("until_", F.sum("n_").over(order))
    # The border is the first block that ends beyond the rest; before it, blocks go in whole.
    border = summed.where(F.col("until_") > F.col("rest_")).groupBy("source_").agg(F.min_by(F.struct("turn_", "block_", (F.col("until_") - F.col("n_")).alias("before_")), F.struct("turn_", "block_")).alias("border_"))
    border = saved(border.select("source_", F.col("border_.turn_").alias("border_turn_"), F.col("border_.block_").alias("border_block_"), F.col("border_.before_").alias("before_")))
    at_border = of_source(placed, border).where((F.col("turn_") == F.col("border_turn_")) & (F.col("block_") == F.col("border_block_")))
    by_key = at_border.groupBy("source_", "doc_turn_", "key_", "rest_", "before_").agg(F.sum("n_").alias("n_"))
    in_block = Window.partitionBy("source_").orderBy("doc_turn_", "key_").rowsBetween(Window.unboundedPreceding, 0)
    fits = by_key.withColumn("until_", F.col("before_") + F.sum("n_").over(in_block)).where(F.col("until_") <= F.col("rest_"))
    last = fits.groupBy("source_").agg(F.max(F.struct("doc_turn_", "key_")).alias("last_"))
    last = saved(last.select("source_", F.col("last_.doc_turn_").alias("last_turn_"), F.col("last_.key_").alias("last_key_")))
    decided = plan.join(border, "source_", "left").join(last, "source_", "left")
    chosen = dealt(of_source(sized, saved(decided)))
    here, edge = F.struct("turn_", "block_"), F.struct(F.col("border_turn_").alias("turn_"), F.col("border_block_").alias("block_"))
    within = F.struct("doc_turn_", "key_") <= F.struct(F.col("last_turn_").alias("doc_turn_"), F.col("last_key_").alias("key_"))
    extra = F.col("border_turn_").isNotNull() & ((here < edge) | ((here == edge) & F.col("last_turn_").isNotNull() & within))
    copies = F.col("full_") + F.when(extra, 1).otherwise(0)
    rows = chosen.withColumn("copies_", copies).where(F.col("copies_") > 0).withColumn("mix_epoch_", F.explode(F.sequence(F.lit(0), F.col("copies_") - 1)))
    return rows.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(names)], "mix_epoch_")


def sql(max_repeats: float = 1.25, seed: str = "mix", block_tokens: int = BLOCK_TOKENS, docs: str = "documents") -> str:
    """The same in DuckDB SQL for a repetition limit and a budget of all tokens."""
    return f"""
    WITH RECURSIVE given AS (
      SELECT d.*, coalesce(source, '<null>') AS source_, coalesce(doc_id::VARCHAR, '<null>') AS key_,
        coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS n_ FROM {docs} d
    ),
    per AS (SELECT source_, sum(n_)::BIGINT AS tokens_ FROM given GROUP BY 1),
    shares AS (SELECT source_, tokens_, tokens_ / (SELECT sum(tokens_) FROM per)::DOUBLE AS p FROM per WHERE tokens_ > 0),
    packed AS (SELECT list(p) AS ps FROM shares),
    bisect(i, low, high) AS (
      SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
      UNION ALL
      SELECT i + 1,
        CASE WHEN list_max(list_transform(ps, lambda x: pow(x, (low + high) / 2) / x)) / list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2))) > {max_repeats} THEN (low + high) / 2 ELSE low END,
        CASE WHEN list_max(list_transform(ps, lambda x: pow(x, (low + high) / 2) / x)) / list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2))) > {max_repeats} THEN high ELSE (low + high) / 2 END
      FROM bisect, packed WHERE i < 48
    ),
    a AS (
      SELECT CASE WHEN (SELECT list_max(list_transform(ps, lambda x: 1 / x)) / len(ps) FROM packed) > {max_repeats} THEN high ELSE 0.0 END AS a FROM bisect WHERE i = 48
    ),
    quota AS (
      SELECT source_, tokens_, round(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, a) * (SELECT sum(tokens_) FROM per))::BIGINT AS quota_ FROM shares, a
      UNION ALL SELECT source_, tokens_, 0 FROM per WHERE tokens_ = 0
    ),
    plan AS (
      SELECT source_, CASE WHEN tokens_ > 0 THEN quota_ // greatest(tokens_, 1) ELSE 1 END AS full_, CASE WHEN tokens_ > 0 THEN quota_ % greatest(tokens_, 1) ELSE 0 END AS rest_,
        ceil(greatest(tokens_, 1) / {block_tokens})::BIGINT AS blocks_ FROM quota
    ),
    dealt AS (
      SELECT g.*, full_, rest_, ('0x' || substr(md5('{seed}|' || key_), 1, 8))::BIGINT % blocks_ AS block_ FROM given g JOIN plan USING (source_)
    ),
    placed AS (
      SELECT *, md5('{seed}|' || source_ || '|' || full_ || '|' || block_) AS turn_, md5('{seed}|' || full_ || '|' || key_) AS doc_turn_ FROM dealt
    ),
    summed AS (
      SELECT *, sum(n_) OVER (PARTITION BY source_ ORDER BY turn_, block_, doc_turn_, key_ RANGE UNBOUNDED PRECEDING) AS until_,
        sum(n_) OVER (PARTITION BY source_ ORDER BY turn_, block_ RANGE UNBOUNDED PRECEDING) AS block_until_ FROM placed
    ),
    rows_ AS (
      SELECT *, full_ + CASE WHEN until_ <= rest_ AND EXISTS (SELECT 1 FROM summed s WHERE s.source_ = summed.source_ AND s.block_until_ > s.rest_) THEN 1 ELSE 0 END AS copies_ FROM summed
    )
    SELECT * EXCLUDE (source_, key_, n_, full_, rest_, block_, turn_, doc_turn_, until_, block_until_, copies_), unnest(range(copies_))::INTEGER AS mix_epoch_ FROM rows_ WHERE copies_ > 0
    """
