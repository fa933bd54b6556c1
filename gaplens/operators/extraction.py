"""Latent needs from a language model: bounded calls, one retry, replies kept by prompt, and rules that no reply can break."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaplens.operators.chat import blended
from gaplens.sources import sinks

# Allowed verdicts, the limits of a reply's fields, the citations of a gap without any.
ALLOWED = ("IGNORED", "MISUNDERSTOOD", "UNDER-PRIORITIZED")
TEXTS = {"latent_need": 500, "verdict": 64, "confidence_justification": 2000, "one_sentence_summary": 500}
OPTIONAL = {"surface_complaint": 500, "workaround": 500}
MOST_CITED = 32
FALLBACK_CITED = 3
#: Calls at a time in all, threads of a task, prompts of a batch: a batch's replies are kept before the next one is asked.
CALLS, THREADS, BATCH = 16, 4, 1024

REPLY = "latent_need string, verdict string, confidence double, confidence_justification string, one_sentence_summary string, cited_review_ids array<string>, surface_complaint string, workaround string"


def parsed(raw: str) -> tuple[dict | None, str]:
    """(fields, "") of a reply, or (None, what is wrong with it)."""
    text = raw.strip()
    if text.startswith("```"):
        text = text.strip("`").removeprefix("json").strip()
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            found = json.loads(text[text.find("{") : text.rfind("}") + 1])
        except json.JSONDecodeError:
            return None, "no JSON"
    if not isinstance(found, dict):
        return None, "no object"
    for name, most in {**TEXTS, **OPTIONAL}.items():
        value = found.get(name, "" if name in OPTIONAL else None)
        if not isinstance(value, str) or len(value) > most:
            return None, f"{name} must be text of at most {most} characters"
    confidence = found.get("confidence")
    if isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not 0 <= confidence <= 100:
        return None, "confidence must be a number from 0 to 100"
    cited = found.get("cited_review_ids", [])
    if not isinstance(cited, list) or len(cited) > MOST_CITED or not all(isinstance(c, str) for c in cited):
        return None, f"cited_review_ids must be at most {MOST_CITED} ids"
    return {**{n: found.get(n, "") for n in (*TEXTS, *OPTIONAL)}, "confidence": float(confidence), "cited_review_ids": cited}, ""


def retry_prompt(prompt: str, problem: str) -> str:
    return f"{prompt}\n\nYour last reply was invalid ({problem}). Return ONLY valid JSON with the named keys."


def _asked(model: Callable[[str], str], threads: int):
    """(hash, prompt) to (hash, reply, problem, calls): reply is checked JSON or null; a failed call is not repeated, an invalid reply once."""

    def one(prompt: str) -> tuple[str | None, str, int]:
        problem, calls, sent = "", 0, prompt
        for _ in range(2):
            calls += 1
            try:
                raw = model(sent)
            except Exception as e:  # noqa: BLE001 - the model is foreign code; its fault degrades this gap only
                return None, f"call failed: {type(e).__name__}", calls
            fields, problem = parsed(raw)
            if fields is not None:
                return json.dumps(fields, sort_keys=True), "", calls
            sent = retry_prompt(prompt, problem)
        return None, f"invalid reply: {problem}", calls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                found = list(pool.map(one, batch.column(1).to_pylist()))
                yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32())], names=["prompt_hash", "reply", "problem", "calls"])

    return run


ANSWERS = "prompt_hash string, reply string, problem string, calls int"


def replies(prompts: DataFrame, model: Callable[[str], str], cache: str, calls: int = CALLS, threads: int = THREADS, batch: int = BATCH) -> DataFrame:
    """(prompt_hash, reply, problem, calls) of prompts (prompt): each different one is asked at most once while its reply is kept under `cache`.

    Tasks times threads bound the calls at a time. Batches are kept as they end: after a lost executor only what its
    task held of one batch is asked again. Good replies stay for later jobs; others stay for this one alone.
    """
    spark = prompts.sparkSession
    asked = prompts.select("prompt").where("prompt is not null").select(F.sha2("prompt", 256).alias("prompt_hash"), "prompt").groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
    good = f"{cache}/replies"
    known = spark.read.schema(ANSWERS).parquet(good) if sinks.exists(spark, good) else spark.createDataFrame([], ANSWERS)
    missing = asked.join(known, "prompt_hash", "left_anti")
    n = missing.count()
    parts = max(1, -(-n // batch))
    tasks = max(1, calls // threads)
    bad, job = None, uuid.uuid4().hex
    for i in range(parts if n else 0):
        part = missing.where(F.pmod(F.xxhash64("prompt_hash"), F.lit(parts)) == i).repartition(tasks, "prompt_hash")
        answers = part.select("prompt_hash", "prompt").mapInArrow(_asked(model, threads), ANSWERS)
        path = f"{cache}/batches/{job}/{i}"
        answers.write.parquet(path)
        done = spark.read.schema(ANSWERS).parquet(path)
        done.where("reply is not null").write.mode("append").parquet(good)
        failed = done.where("reply is null")
        bad = failed if bad is None else bad.unionByName(failed)
    kept = spark.read.schema(ANSWERS).parquet(good) if sinks.exists(spark, good) else known
    out = asked.select("prompt_hash").join(kept.dropDuplicates(["prompt_hash"]), "prompt_hash")
    return out if bad is None else out.unionByName(bad)


def extract(candidates: DataFrame, model: Callable[[str], str], cache: str, mode: str = "none", calls: int = CALLS, threads: int = THREADS, batch: int = BATCH) -> DataFrame:
    """Gaps from candidates (cluster_id, prompt, provided array<string>, verdict, deterministic, quote, quote_id).

    With a reply: its texts, its confidence blended 0.6 to 0.4 with the deterministic one, its citations among the provided ids
    (the first three of those if none is), its verdict if the mode allows it, else the candidate's; without a roadmap every
    verdict is UNVERIFIED. Without one: the representative review quoted as it is, the deterministic confidence, and a note.
    """
    found = replies(candidates.select("prompt"), model, cache, calls, threads, batch)
    rows = candidates.withColumn("prompt_hash", F.sha2("prompt", 256)).join(found, "prompt_hash", "left").withColumn("r", F.from_json("reply", REPLY))
    used = F.col("reply").isNotNull()
    text = lambda name, most: F.substring(F.trim(F.col(f"r.{name}")), 1, most)
    cited = F.filter(F.col("r.cited_review_ids"), lambda c: F.array_contains("provided", c))
    first = F.slice("provided", 1, FALLBACK_CITED)
    said: Column = F.upper(F.trim("r.verdict"))
    verdict = F.lit("UNVERIFIED") if mode == "none" else F.when(used & said.isin(*ALLOWED), said).otherwise(F.col("verdict"))
    alone = F.when(F.col("quote_id").isNotNull(), F.array("quote_id")).otherwise(first)
    return rows.select(
        "cluster_id",
        F.when(used, text("latent_need", 500)).otherwise(F.col("quote")).alias("need"),
        verdict.alias("verdict"),
        blended(F.col("deterministic"), F.col("r.confidence")).alias("confidence"),
        F.col("r.confidence").alias("llm_confidence"),
        F.when(used, text("one_sentence_summary", 500)).alias("summary"),
        F.when(~used, alone).when(F.size(cited) > 0, cited).otherwise(first).alias("cited"),
        used.alias("llm_used"),
        F.when(used, "llm").otherwise("representative_review").alias("need_source"),
        F.nullif(text("surface_complaint", 500), F.lit("")).alias("surface"),
        F.nullif(text("workaround", 500), F.lit("")).alias("workaround"),
        F.when(~used, F.coalesce("problem", F.lit("no prompt"))).alias("degraded"),
        F.coalesce("calls", F.lit(0)).alias("calls"),
    )
