"""Whether matching can be trusted: retrieval calibrated on probes in three lexical spaces, and the null test of groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaplens.operators import analysis, matching
from gaplens.operators.lexical import FEATURES, _clean, _found
from gaplens.sources.shared import settled

# The separation that matching has to reach; the dates that make every item one of the window's time.
LEAST_SEPARATION = 0.35
FORCED_FROM, FORCED_UNTIL = "2010-01-01", "2099-01-01"
#: Probes of a chunk, items of a block and items held against a chunk at a time.
PROBES, ITEMS, ROWS = 128, 1 << 16, 128


def weighed_spaces(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(mode, key, places, weights): the unit TF-IDF rows of a corpus in all spaces of FEATURES, from one count of its terms.

    A space keeps the terms of greatest count of each kind, the first in the alphabet on ties, so the smaller vocabularies are heads of the larger.
    """
    clean = _clean(docs, key, text)
    n = clean.count()
    kinds = sorted({kind for parts in FEATURES.values() for kind, _ in parts})
    counts = vocabulary = None
    for kind in kinds:
        tf = clean.select("id", F.explode(_found(kind)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")).withColumn("kind", F.lit(kind))
        most = max(m for parts in FEATURES.values() for k, m in parts if k == kind)
        best = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("docs")).orderBy(F.desc("total"), "term").limit(most)
        place = F.row_number().over(Window.orderBy(F.desc("total"), "term"))  # at most `most` rows
        modes = F.array_compact(F.array(*[F.when(place <= m, mode) for mode, parts in FEATURES.items() for k, m in parts if k == kind]))
        known = best.select("term", (F.log((1.0 + n) / (1 + F.col("docs"))) + 1).alias("idf"), (place * len(kinds) + kinds.index(kind)).alias("place"), modes.alias("modes"), F.lit(kind).alias("kind"))
        counts = tf if counts is None else counts.unionByName(tf)
        vocabulary = known if vocabulary is None else vocabulary.unionByName(known)
    rows = counts.join(F.broadcast(vocabulary), ["kind", "term"])  # at most the terms of FEATURES
    cell = rows.select("id", "kind", "place", ((1 + F.log("tf")) * F.col("idf")).alias("w"), F.explode("modes").alias("mode"))
    parts = cell.groupBy("mode", "kind", "id").agg(F.collect_list(F.struct("place", "w")).alias("row"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))  # a document's terms
    even = parts.withColumn("row", F.transform("row", lambda x: F.struct(x["place"].alias("place"), (x["w"] / F.col("norm")).alias("w"))))
    whole = even.groupBy("mode", "id").agg(F.array_sort(F.flatten(F.collect_list("row"))).alias("row"), F.sqrt(F.count("*").cast("double")).alias("norm"))  # two kinds at most
    return whole.select("mode", F.col("id").alias(key), F.transform("row", lambda x: x["place"]).alias("places"), F.transform("row", lambda x: x["w"] / F.col("norm")).alias("weights"))


def _dense(table: pa.Table, used: np.ndarray) -> np.ndarray:
    """Sparse rows as a matrix over the sorted places `used`; cells elsewhere are left out."""
    places, values = (table[c].combine_chunks() for c in ("places", "weights"))
    row = np.repeat(np.arange(len(table)), places.value_lengths().to_numpy(zero_copy_only=False))
    at, w = places.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    column = np.minimum(np.searchsorted(used, at), max(len(used) - 1, 0))
    hit = used[column] == at if len(used) else np.zeros(len(at), bool)
    out = np.zeros((len(table), len(used)))
    out[row[hit], column[hit]] = w[hit]
    return out


def _ranked(probes: pa.Table, items: pa.Table) -> pa.Table:
    """A chunk of probes against a block of items: (mode, probe_id, item_id, sim) of the best two, and with item_id null how many beat or tie the expected one."""
    items = items.sort_by("item_id")
    ids, aims = items["item_id"].to_pylist(), probes["aim"].to_pylist()
    expected = probes["expected_id"].to_pylist()
    used = np.unique(probes["places"].combine_chunks().flatten().to_numpy(zero_copy_only=False)) if len(probes) else np.zeros(0, np.int32)
    left = _dense(probes, used)
    best: list[list[tuple[float, object, float]]] = [[] for _ in range(len(probes))]
    beaten = [0] * len(probes)
    for first in range(0, len(items), ROWS):
        sims = left @ _dense(items.slice(first, ROWS), used).T
        keys = np.round(sims, 12)
        names = ids[first : first + ROWS]
        for i in range(len(probes)):
            two = np.argsort(-keys[i], kind="stable")[:2]
            best[i] = sorted([*best[i], *((-keys[i, j], names[j], sims[i, j]) for j in two)], key=lambda x: x[:2])[:2]
            if aims[i] is not None:
                beaten[i] += int((keys[i] > aims[i]).sum()) + sum(names[j] <= expected[i] for j in np.flatnonzero(keys[i] == aims[i]))
    mode, probe = probes["mode"].to_pylist(), probes["probe_id"].to_pylist()
    rows = [(mode[i], probe[i], name, float(sim), 0) for i in range(len(probes)) for _, name, sim in best[i]] + [(mode[i], probe[i], None, None, beaten[i]) for i in range(len(probes))]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.string(), probes.schema.field("probe_id").type, items.schema.field("item_id").type, pa.float64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["mode", "probe_id", "item_id", "sim", "beaten"])


def retrieval(items: DataFrame, probes: DataFrame) -> DataFrame:
    """(mode, probe_id, expected_id, top1, s1, s2, place) of probes (probe_id, text, expected_id) among items (item_id, text) in each space.

    Items and probes are one corpus. Probes and blocks of items meet in tasks that answer with two items and a count a probe.
    An expected id that is no item, or null, has no place; a second similarity is 0 where there is one item.
    """
    types = dict(items.dtypes) | {"probe_id": dict(probes.dtypes)["probe_id"]}
    corpus = items.select(F.struct(F.lit("i").alias("of"), F.col("item_id").cast("string").alias("id")).alias("doc"), "text").unionByName(probes.select(F.struct(F.lit("p").alias("of"), F.col("probe_id").cast("string").alias("id")).alias("doc"), "text"))
    rows = settled(weighed_spaces(corpus, "doc", "text"))  # read for items, probes and expected items
    cast = lambda c, name: F.col(c).cast(types[name]).alias(name)
    found = rows.where("doc.of = 'i'").select("mode", cast("doc.id", "item_id"), "places", "weights")
    every = F.explode(F.array(*map(F.lit, sorted(FEATURES)))).alias("mode")
    none = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("places", "int"), ("weights", "double"))]
    seen = lambda kept, key: kept.unionByName(items.select(every, key, *none).join(kept.select("mode", key), ["mode", key], "left_anti"))
    found = seen(found, "item_id")
    asked = probes.select(every, "probe_id", "expected_id").join(rows.where("doc.of = 'p'").select("mode", cast("doc.id", "probe_id"), "places", "weights"), ["mode", "probe_id"], "left")
    asked = asked.withColumn("places", F.coalesce("places", none[0])).withColumn("weights", F.coalesce("weights", none[1]))
    own = asked.join(found.select("mode", F.col("item_id").alias("expected_id"), F.map_from_arrays("places", "weights").alias("cells")), ["mode", "expected_id"])
    product = F.aggregate(F.zip_with("places", "weights", lambda p, w: w * F.coalesce(F.try_element_at("cells", p), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    asked = settled(asked.join(own.select("mode", "probe_id", F.round(product, 12).alias("aim")), ["mode", "probe_id"], "left"))  # the probes
    blocks, chunks = max(1, -(-items.count() // ITEMS)), max(1, -(-probes.count() // PROBES))
    numbers = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = asked.withColumn("__chunk", F.pmod(F.xxhash64("probe_id"), F.lit(chunks)).cast("int")).withColumn("__block", numbers(blocks))
    right = found.withColumn("__block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).withColumn("__chunk", numbers(chunks))
    key = ("mode", "__block", "__chunk")
    schema = f"mode string, probe_id {types['probe_id']}, item_id {types['item_id']}, sim double, beaten long"
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_ranked, schema)
    best = F.when(F.col("item_id").isNotNull(), F.struct((-F.round("sim", 12)).alias("s"), "item_id", "sim"))
    order = F.array_sort(F.collect_list(best))  # two of each block
    top = met.groupBy("mode", "probe_id").agg(order.alias("o"), F.sum("beaten").alias("place"))
    out = asked.select("mode", "probe_id", "expected_id", "aim").join(top, ["mode", "probe_id"])
    second = F.try_element_at("o", F.lit(2))
    return out.select("mode", "probe_id", "expected_id", F.col("o")[0]["item_id"].alias("top1"), F.col("o")[0]["sim"].alias("s1"), F.coalesce(second["sim"], F.lit(0.0)).alias("s2"), F.when(F.col("aim").isNotNull(), F.col("place")).alias("place"))


def calibration_run(ranks: DataFrame) -> DataFrame:
    """One row a space: probes, hits, least true score, greatest runner-up and negative, overlap, threshold, margin, the worst place of an expected item, and whether the space is recommended.

    Character n-grams are, unless the union of both kinds finds more.
    """
    positive = F.col("expected_id").isNotNull()
    probes = ranks.select("mode", "place", positive.alias("positive"), F.coalesce(F.col("top1") == F.col("expected_id"), F.lit(False)).alias("hit"), F.round("s1", 4).alias("s1"), F.round("s2", 4).alias("s2"))
    found = analysis.calibration(probes, "mode").join(probes.groupBy("mode").agg(F.count_if("positive").alias("probes"), F.max("place").alias("worst_place")), "mode")
    best = found.agg(F.when(F.coalesce(F.max(F.when(F.col("mode") == "union", F.col("hits"))), F.lit(0)) > F.coalesce(F.max(F.when(F.col("mode") == "char_wb", F.col("hits"))), F.lit(0)), "union").otherwise("char_wb").alias("best"))
    return found.crossJoin(F.broadcast(best)).select("mode", "probes", "hits", "min_true", "max_runner", "max_negative", "overlap", "threshold", "margin", "worst_place", (F.col("mode") == F.col("best")).alias("recommended"))  # one row


def null_test(members: DataFrame, items: DataFrame, threshold: float, real: str, end: Column | None = None) -> DataFrame:
    """One row a group of clustered reviews (group, cluster_id, member_id, embedding, rating, member_at) against one roadmap.

    clusters, fired (the vote is agreed and reaches the threshold) and their rate; mean_top1, where a cluster without agreement
    counts 0; the verdicts; the share of gaps that a later item addresses; the real group's rate less the mean of the others',
    and whether that clears LEAST_SEPARATION. Without an end every item counts as open in the window's time, so rates tell of matching alone.
    """
    date = lambda text: F.lit(text).cast("timestamp")
    plans = items
    if end is None:
        plans = items.select("item_id", "embedding", F.lit("").alias("title"), F.lit("open").alias("state"), date(FORCED_FROM).alias("created_at"), date(FORCED_FROM).alias("updated_at"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(False).alias("has_milestone"))
    keyed = members.withColumn("cluster_id", F.concat_ws("\u0001", F.col("cluster_id").cast("string"), F.col("group")))
    until = date(FORCED_UNTIL) if end is None else end
    judged = analysis.judged(keyed, plans, until, threshold)
    if end is None:
        judged = judged.withColumn("later", F.lit(False))
    else:
        later = analysis.later_addressed(keyed, plans, until, threshold).select("cluster_id", F.lit(True).alias("__later"))
        judged = judged.join(later, "cluster_id", "left").withColumn("later", F.coalesce("__later", F.lit(False)))
    group = F.substring_index("cluster_id", "\u0001", -1).alias("group")
    of = lambda verdict: F.count_if(F.coalesce(F.col("verdict") == verdict, F.lit(False)))
    gap = F.col("verdict").isNotNull()
    rates = judged.groupBy(group).agg(
        F.count("*").alias("clusters"), F.count_if("ok").alias("fired"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("mean_top1"),
        of("IGNORED").alias("ignored"), of("UNDER-PRIORITIZED").alias("under_prioritized"), of("MISUNDERSTOOD").alias("misunderstood"),
        F.count_if(gap).alias("gaps"), F.round(F.coalesce(F.count_if(gap & F.col("later")) / F.nullif(F.count_if(gap), F.lit(0)), F.lit(0.0)), 6).alias("validated_rate"),
    )
    rates = rates.withColumn("rate", F.col("fired") / F.col("clusters"))
    apart = rates.agg(F.round(F.avg(F.when(F.col("group") == real, F.col("rate"))) - F.avg(F.when(F.col("group") != real, F.col("rate"))), 6).alias("separation"))
    return rates.withColumn("rate", F.round("rate", 6)).crossJoin(F.broadcast(apart)).withColumn("clears", F.coalesce(F.col("separation") >= LEAST_SEPARATION, F.lit(False)))  # one row
