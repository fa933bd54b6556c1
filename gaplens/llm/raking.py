"""Mixing sources to target weights by iterative proportional fitting (operator 3).

Documents fall into cells of (source, language, topic); a cell weighs its tokens
(words). Raking multiplies cell weights, one dimension after another, until the weights
of every source, language and topic meet their target shares. A document of a cell then has
the weight keep * raked / observed, so the expected tokens drawn are `keep` of all and meet
the targets. `mix_weights` draws by weights above 1 as well, as whole copies and one more by
chance; `mix_sources` draws each document once at most, with probability min(1, c * raked /
observed), c for `keep` of the tokens. Its cells at probability 1 stay under their targets:
`once_share` and `marginals` tell by how much. The coin is a hash of seed, id and text, so
that a rerun or another partitioning draws the same documents.

Targets are shares by value and dimension; a dimension without any gets its observed
shares to the power `flatten`, rescaled. Values a given target does not name share no
weight and are never drawn. Only DataFrame functions: cells are aggregated before any
shuffle of rows, factors are joined under a checked broadcast, and each round is
written to the shared folder.

Defined results: null dimensions are values of their own (empty text); null and empty
texts have no tokens and take their cell's probability, 1 where the cell has no tokens;
repeated rows share a coin; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaplens.llm.common import released, saved, small

DIMS = ["source", "lang", "topic"]
FLATTEN = 0.7
KEEP = 0.8
ROUNDS = 60
TOLERANCE = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_topic(text: Column) -> Column:
    """A topic by form: 'technical' (3 % or more digits and symbols), 'listing' (lines under 60 characters), else 'prose'."""
    size = F.length(text)
    plain = F.length(F.translate(text, "0123456789#*$%&|<>{}=_@", ""))
    lines = size - F.length(F.translate(text, "\n", "")) + 1
    topic = F.when(100 * (size - plain) >= 3 * size, "technical").when(size < 60 * lines, "listing").otherwise("prose")
    return F.when(size > 0, topic).otherwise("")


def _dim(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _dims(topic: Column, source_col: str, lang_col: str) -> list[Column]:
    return [_dim(source_col).alias("source"), _dim(lang_col).alias("lang"), F.coalesce(topic, F.lit("")).alias("topic")]


def _shares(cells: DataFrame, dim: str, given: dict[str, float] | None, flatten: float) -> DataFrame:
    """(dim, share) of the values that occur, summing to 1."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    if given is None:
        sums = sums.select(dim, F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(flatten))).otherwise(F.lit(0.0)).alias("x"))
    else:
        rows = [(k, float(v)) for k, v in given.items()]
        wanted = cells.sparkSession.createDataFrame(rows, f"`{dim}` string, x double")
        sums = sums.where("t > 0").join(F.broadcast(wanted), dim)  # a parameter's few rows
    total = sums.agg(F.sum("x").alias("all"))
    return sums.crossJoin(F.broadcast(total)).select(dim, (F.col("x") / F.nullif(F.col("all"), F.lit(0.0))).alias("share"))  # one row


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], flatten: float = FLATTEN, rounds: int = ROUNDS) -> DataFrame:
    """cells (DIMS, tokens) and `weight`: their tokens raked to the target shares."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMS:
        now = now.join(small(saved(_shares(cells, d, targets.get(d), flatten)), 200).withColumnRenamed("share", f"__share_{d}"), d, "left")
    now = saved(now)
    for i in range(rounds):
        for d in DIMS:  # saved each time: a step's plan reads its cells twice, so three in one plan would read them eight times
            factors = now.groupBy(d).agg(F.sum("weight").alias("w"), F.first(f"__share_{d}").alias("share"))  # one share a value
            factors = factors.select(d, F.when(F.col("w") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("w")).otherwise(F.lit(0.0)).alias("__f"))
            fresh = now.drop(f"__off_{d}").join(factors, d)
            fresh = saved(fresh.withColumn("weight", F.col("weight") * F.col("__f")).withColumn(f"__off_{d}", F.abs(F.col("__f") - 1)).drop("__f"))
            released(now)
            now = fresh
        worst = now.where("weight > 0").agg(F.max(F.greatest(*[F.col(f"__off_{d}") for d in DIMS]))).first()[0]
        if worst is None or (i and worst < TOLERANCE):
            break
    return now.select(*cells.columns, "weight")


def calibrated(raked: DataFrame, keep: float) -> DataFrame:
    """raked, `ratio` (the weight that keeps `keep` of the tokens and the targets) and `p`, the probability of a document drawn once at most."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    cells = saved(raked.withColumn("ratio", ratio))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale = keep
    full = F.col("ratio") * scale >= 1
    while total:  # each pass caps further cells or ends
        capped, n, free = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free or capped >= keep * total:
            break
        scale = max(scale, (keep * total - capped) / free)
        full = F.col("ratio") * scale >= 1
        if cells.agg(F.sum(F.when(full, 1).otherwise(0))).first()[0] == n:
            break
    once = F.round(F.coalesce(F.least(F.lit(1.0), F.col("ratio") * scale), F.lit(1.0)), 6)
    return cells.withColumn("p", once).withColumn("ratio", F.round(F.coalesce(F.col("ratio") * keep, F.lit(1.0)), 4))


def _coin(seed: int, id_col: Column, text: Column) -> Column:
    """A number from 0 to 1 that any engine can recompute: 52 bits of an MD5."""
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _fitted(slim: DataFrame, targets: dict[str, dict[str, float]], flatten: float, keep: float) -> DataFrame:
    cells = saved(slim.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")))
    return saved(calibrated(rake(cells, targets, flatten), keep))


def mix_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, flatten: float = FLATTEN, keep: float = KEEP, seed: int = 7) -> DataFrame:
    """id, DIMS, n_tokens, weight, copies drawn, and p and sampled (drawn once at most) of every row of docs; and the cell's share of the
    tokens: observed, target, and once_share, what drawing once at most is expected to give it."""
    text = F.col(text_col).cast("string")
    topic = text_topic(text) if topic is None else topic
    slim = saved(docs.select(F.col(id_col).alias("row_id"), *_dims(topic, source_col, lang_col), n_tokens(text).alias("tokens"), _coin(seed, F.col(id_col), text).alias("coin")))
    cells = _fitted(slim, targets or {}, flatten, keep)
    sums = cells.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"), F.sum(F.col("tokens") * F.col("p")).alias("o"))
    share = lambda part, whole: F.round(F.coalesce(part / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0)), 6)
    given = cells.crossJoin(F.broadcast(sums)).select(*DIMS, "ratio", "p", share(F.col("tokens"), "t").alias("observed"), share(F.col("weight"), "w").alias("target"), share(F.col("tokens") * F.col("p"), "o").alias("once_share"))  # one row
    joined = slim.join(small(saved(given), 300), DIMS)
    copies = F.floor("ratio") + (F.col("coin") < F.col("ratio") - F.floor("ratio")).cast("long")
    return joined.select(F.col("row_id").alias(id_col), *DIMS, F.col("tokens").alias("n_tokens"), F.col("ratio").alias("weight"), copies.alias("copies"), F.round("p", 4).alias("p"), (F.col("coin") < F.col("p")).alias("sampled"), "observed", "target", "once_share")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, flatten: float = FLATTEN, keep: float = KEEP, seed: int = 7) -> DataFrame:
    """The sampled rows of docs with their own columns; texts are read twice, never shuffled under the broadcast bound."""
    text = F.col(text_col).cast("string")
    topic = text_topic(text) if topic is None else topic
    dims = _dims(topic, source_col, lang_col)
    cells = _fitted(docs.select(*dims, n_tokens(text).alias("tokens")), targets or {}, flatten, keep)
    marked = docs.select(*docs.columns, *[d.alias(f"__{n}") for d, n in zip(dims, DIMS, strict=True)])
    fitted = small(cells.select(*[F.col(n).alias(f"__{n}") for n in DIMS], F.col("p").alias("__p")), 200)
    drawn = marked.join(fitted, [f"__{n}" for n in DIMS]).where(_coin(seed, F.col(id_col), text) < F.col("__p"))
    return drawn.select(docs.columns)


def marginals(cells: DataFrame) -> DataFrame:
    """(dim, value, target, expected): raked and expected shares of each marginal, from calibrated cells."""
    total = cells.agg(F.sum("weight").alias("tw"), F.sum(F.col("tokens") * F.col("p")).alias("tp"))
    rows = cells.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in DIMS])).alias("m"), "weight", (F.col("tokens") * F.col("p")).alias("kept"))
    sums = rows.groupBy("m.dim", "m.value").agg(F.sum("weight").alias("w"), F.sum("kept").alias("k"))
    return sums.crossJoin(F.broadcast(total)).select("dim", "value", (F.col("w") / F.col("tw")).alias("target"), (F.col("k") / F.col("tp")).alias("expected"))  # one row
