"""Prompt texts. The wording is a fixed value: cached scores depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, titled

VERBALIZERS = {"SUPPORTS": ["A", " A", "\nA"], "REFUTES": ["B", " B", "\nB"]}


def display_label(label: str) -> str:
    return label.replace("_", " ")


def claim_prompt(claim: Column, labels: list[str], verbalizers: dict[str, list[str]], evidence: Column | None = None) -> Column:
    """Prompt for a claim, with evidence where that isn't null; a blank claim is an error."""
    menu = []
    for label in labels:
        names = verbalizers.get(label)
        if not names or not names[0].strip():
            raise ValueError(f"no verbalizer for {label}")
        menu.append(f"{names[0].strip()}. {display_label(label)}")
    if not menu:
        raise ValueError("no labels")
    head = F.lit("You are a fact verification model.\n\n")
    if evidence is not None:
        block = F.concat(F.lit("Evidence:\n"), strip(evidence), F.lit("\n\n"))
        head = F.concat(head, F.coalesce(block, F.lit("")))
    body = F.concat(head, F.lit("Claim:\n"), strip(claim), F.lit("\n\nChoose the correct label:\n" + "\n".join(menu) + "\n\nAnswer:"))
    return F.when(F.coalesce(strip(claim), F.lit("")) != "", body).otherwise(F.raise_error(F.lit("blank claim")))


def prompt_contract(labels: list[str], verbalizers: dict[str, list[str]]) -> Column:
    """Fingerprint of wording, labels and verbalizers: scores under different ones must not be mixed."""
    sample = claim_prompt(F.lit("claim"), labels, verbalizers, F.lit("evidence"))
    names = [F.array(*(F.lit(v) for v in verbalizers[label])) for label in labels]
    return F.sha2(F.to_json(F.struct(sample.alias("prompt"), F.array(*map(F.lit, labels)).alias("labels"), F.array(*names).alias("verbalizers"))), 256)


def evidence_block(docs: Column) -> Column:
    """Numbered documents with their titles, a blank line between."""
    one = lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.when(F.coalesce(d["title"], F.lit("")) != "", F.concat(F.lit("Title: "), d["title"], F.lit("\n"))).otherwise(F.lit("")), F.coalesce(d["text"], F.lit("")))
    return F.array_join(F.transform(docs, one), "\n\n")


TASK = "\n\nTask:\nScore how useful the candidate evidence is as an additional evidence item for verifying the claim, considering the already selected evidence."
MAX_DOCS, MAX_QUERY, MAX_CANDIDATE, MAX_SELECTED = 4, 2000, 5000, 5000


def selector_head(query: Column, candidate: Column, max_query: int = MAX_QUERY, max_candidate: int = MAX_CANDIDATE) -> Column:
    """A selector's input up to the selected evidence: the same in every state."""
    return F.concat(
        F.lit("Claim:\n"),
        F.substring(F.coalesce(query, F.lit("None")), 1, max_query),
        F.lit("\n\nCandidate evidence:\n"),
        F.substring(titled(candidate["title"], candidate["text"]), 1, max_candidate),
        F.lit("\n\nAlready selected evidence:\n"),
    )


def selector_history(selected: list[str], max_docs: int = MAX_DOCS, max_selected: int = MAX_SELECTED) -> str:
    """What follows the head in a state: the last selected documents (``titled``), numbered, and the task."""
    shown = "\n".join(f"[{i + 1}] {d}" for i, d in enumerate(selected[-max_docs:])) if selected else "None"
    return shown[:max_selected] + TASK


def selector_input(query: Column, candidate: Column, selected: Column, max_docs: int = MAX_DOCS, max_query: int = MAX_QUERY, max_candidate: int = MAX_CANDIDATE, max_selected: int = MAX_SELECTED) -> Column:
    """State-aware input of a scoring model; claim and candidate come before the history."""
    last = F.slice(selected, F.greatest(F.size(selected) - (max_docs - 1), F.lit(1)), max_docs)
    history = F.array_join(F.transform(last, lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), titled(d["title"], d["text"]))), "\n")
    history = F.when(F.size(selected) > 0, history).otherwise(F.lit("None"))
    return F.concat(selector_head(query, candidate, max_query, max_candidate), F.substring(history, 1, max_selected), F.lit(TASK))
