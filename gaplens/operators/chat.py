"""Grounded chat over a finished job: evidence packs, messages, replies and their citations. The model itself is the caller's."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaplens.functions.text import python_repr

# How much of a job, a snippet and a talk a model gets.
MAX_PACK = 12_000
MAX_SNIPPET = 240
MAX_TURNS = 8
MAX_MESSAGE = 4_000
CUT_MARK = "\n\n[truncated for length]"


def gap_lines(gap: Column) -> Column:
    """The lines of one gap; gap: struct(rank, need, verdict, confidence, hiddenness, insight, summary, keywords, surfaces,
    workarounds, matched, similarity, state, evidence array<struct(id, kind, review_id, title, snippet, url)>), all texts but rank and lists."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    listed = lambda label, items: F.when(F.size(items) > 0, F.array(F.concat(F.lit(label), F.array_join(items, "; ")))).otherwise(F.array().cast("array<string>"))
    head = F.array(
        F.concat(F.lit("### Gap #"), gap["rank"].cast("string")), F.concat(F.lit("Need: "), F.coalesce(gap["need"], F.lit(""))), F.concat(F.lit("Verdict: "), F.coalesce(gap["verdict"], F.lit(""))),
        F.concat(F.lit("Confidence: "), shown(gap["confidence"])), F.concat(F.lit("Hiddenness: "), shown(gap["hiddenness"])), F.concat(F.lit("Insight score: "), shown(gap["insight"])),
        F.concat(F.lit("Summary: "), F.coalesce(gap["summary"], F.lit(""))), F.concat(F.lit("Keywords: "), F.array_join(gap["keywords"], ", ")),
    )
    matched = F.when(F.coalesce(gap["matched"], F.lit("")) != "", F.array(F.concat(F.lit("Matched roadmap: "), gap["matched"], F.lit(" (sim="), shown(gap["similarity"]), F.lit(", state="), shown(gap["state"]), F.lit(")")))).otherwise(F.array().cast("array<string>"))

    def line(e: Column) -> Column:
        text = lambda name: F.coalesce(e[name], F.lit(""))
        review = F.when(text("review_id") != "", F.concat(F.lit(" review_id="), text("review_id"))).otherwise("")
        return F.concat(F.lit("  - ["), text("kind"), F.lit("] id="), text("id"), review, F.lit(" title="), python_repr(F.substring(text("title"), 1, 120)), F.lit(" snippet="), python_repr(F.substring(text("snippet"), 1, MAX_SNIPPET)), F.lit(" url="), text("url"))

    return F.concat(head, listed("Surface complaints: ", gap["surfaces"]), listed("Workarounds: ", gap["workarounds"]), matched, F.array(F.lit("Evidence:")), F.transform(gap["evidence"], line), F.array(F.lit("")))


def evidence_pack(app: Column, package: Column, source: Column, summary: Column, stats: Column, gaps: Column, most: int = MAX_PACK) -> Column:
    """All that a model may use of a job, best gaps first (`gaps` is sorted by rank); what exceeds `most` characters is cut with a mark."""
    head = F.array(
        F.concat(F.lit("App: "), F.coalesce(app, F.lit("")), F.lit(" ("), F.coalesce(package, F.lit("")), F.lit(")")), F.concat(F.lit("Roadmap source: "), F.coalesce(F.nullif(source, F.lit("")), F.lit("none"))),
        F.concat(F.lit("Summary: "), F.coalesce(summary, F.lit(""))), F.concat(F.lit("Stats: "), stats), F.lit(""), F.lit("GAPS AND EVIDENCE:"),
    )
    pack = F.regexp_replace(F.array_join(F.concat(head, F.flatten(F.transform(gaps, gap_lines))), "\n"), r"^\s+|\s+$", "")
    cut = F.concat(F.regexp_replace(F.substring(pack, 1, most - 40), r"\s+$", ""), F.lit(CUT_MARK))
    return F.when(F.length(pack) <= most, pack).otherwise(cut)


def messages(pack: str, question: str, history: list[dict[str, str]]) -> list[dict[str, str]]:
    """What a model is sent: its task, the pack, the last turns and the question."""
    task = (
        "You are an evidence analyst. Answer ONLY from the EVIDENCE PACK; invent no needs, reviews or roadmap items, and say so if it does not suffice. "
        'Reply with JSON only: {"answer": string, "citations": [{"gap_rank": number|null, "evidence_id": string|null, "quote": string}]}'
    )
    ready = json.dumps({"answer": "Ready. Ask about this job's gaps and evidence.", "citations": []})
    start = [{"role": "system", "content": task}, {"role": "user", "content": f"EVIDENCE PACK:\n{pack}\n\n(End of pack. Wait for the question.)"}, {"role": "assistant", "content": ready}]
    return [*start, *({"role": t["role"], "content": t["content"][:MAX_MESSAGE]} for t in history[-MAX_TURNS:]), {"role": "user", "content": question.strip()[:MAX_MESSAGE]}]


def salvaged_json(raw: Column) -> Column:
    """The JSON object in a reply: the reply without its code fence, else its outermost braces; null if neither parses."""
    fence = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.trim(F.when(fence == "", raw).otherwise(fence))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    valid = lambda c: F.when(F.get_json_object(c, "$").isNotNull() & c.startswith("{"), c)
    return F.coalesce(valid(text), valid(F.nullif(braces, F.lit(""))))


def bounded(need: Column, verdict: Column, confidence: Column, summary: Column, cited: Column) -> Column:
    """Whether a reply keeps its limits: lengths of 500, 64 and 2000, 32 citations, a confidence from 0 to 100."""
    return F.coalesce((F.length(need) <= 500) & (F.length(verdict) <= 64) & confidence.between(0, 100) & (F.length(summary) <= 2000) & (F.size(cited) <= 32), F.lit(False))


def repaired_citations(citations: Column, ranks: Column, ids: Column) -> Column:
    """Citations array<struct(gap_rank, evidence_id, quote)> without unknown ranks and ids; one that says nothing more goes."""
    known = F.transform(
        citations,
        lambda c: F.struct(
            F.when(F.array_contains(ranks, c["gap_rank"]), c["gap_rank"]).alias("gap_rank"),
            F.when((c["evidence_id"] == "") | F.array_contains(ids, c["evidence_id"]), c["evidence_id"]).alias("evidence_id"),
            c["quote"].alias("quote"),
        ),
    )
    said = lambda text: F.coalesce(text, F.lit("")) != ""
    return F.filter(known, lambda c: said(c["quote"]) | c["gap_rank"].isNotNull() | said(c["evidence_id"]))


def answer(pack: str, question: str, history: list[dict[str, str]], model: Callable[[list[dict[str, str]]], str], ranks: set[int], ids: set[str]) -> dict[str, Any]:
    """A model's answer with citations that exist; asked once more if its reply is no JSON, ValueError if that is none either."""
    if not question.strip():
        raise ValueError("empty question")
    sent = messages(pack, question, history)
    reply = model(sent)
    found = _parsed(reply)
    if found is None:
        found = _parsed(model([*sent, {"role": "assistant", "content": reply[:2000]}, {"role": "user", "content": "That was no valid JSON. Return ONLY JSON with the keys answer and citations."}]))
    if found is None:
        raise ValueError("the reply is no JSON")
    kept = []
    for c in found.get("citations", ()):
        rank = c.get("gap_rank") if c.get("gap_rank") in ranks else None
        evidence = c.get("evidence_id") if not c.get("evidence_id") or c["evidence_id"] in ids else None
        if c.get("quote") or rank is not None or evidence:
            kept.append({"gap_rank": rank, "evidence_id": evidence, "quote": c.get("quote", "")})
    return {"answer": str(found.get("answer", "")).strip(), "citations": kept}


def _parsed(raw: str) -> dict[str, Any] | None:
    text = raw.strip()
    if "```" in text:
        text = text.split("```", 2)[1].removeprefix("json").strip()
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(part)
        except json.JSONDecodeError:
            continue
        if isinstance(found, dict) and "answer" in found:
            return found
    return None


def extraction_prompt(sample: Column, matched: Column, verdict: Column, mode: str, keywords: Column) -> Column:
    """What a model is asked for a cluster: the latent need behind its reviews, as JSON with bounded fields."""
    return F.concat_ws(
        "\n",
        F.lit("Extract the latent need (the unspoken goal) behind these reviews."),
        F.lit(f"Roadmap mode: {mode}"),
        F.concat(F.lit("Preliminary verdict: "), verdict),
        F.concat(F.lit("Cluster keywords: "), F.array_join(keywords, ", ")),
        F.concat(F.lit("Closest roadmap item (or null): "), F.coalesce(matched, F.lit("null"))),
        F.concat(F.lit("Reviews (with ids): "), sample),
        F.lit("Return JSON: latent_need, verdict, confidence (0-100), one_sentence_summary, cited_review_ids (a subset of the given ids)."),
    )


def blended(deterministic: Column, model: Column) -> Column:
    """Final confidence: 0.6 of the deterministic one and 0.4 of the model's, if there is one."""
    return F.round(F.when(model.isNull(), deterministic).otherwise(0.6 * deterministic + 0.4 * model), 2)
