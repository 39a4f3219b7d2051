"""Quality rules as a ledger of failure bits, with policies and ablations on top.

``ledger`` evaluates every rule once for each document and stores one bit for
each rule that fails, beside the measurements the rules are made of. What to keep is
decided later: a policy is a named, versioned set of rules, so applying one or
another is a bitwise AND over the ledger, and so is an ablation, which tells how
many documents a policy rejects by one rule alone.

Given the markers that ``toxicity.fit`` learned from labels, the ledger also counts toxic words in every
language of the labels, and the rules of ``LEARNED`` have the bits after the others; the policies of ``LEARNED_POLICIES`` need them.

Words are the stretches without ASCII white space. Null texts count as empty; an
empty text has no words, all counts are 0, and it fails ``few_words``; rows that
repeat give rows that repeat; null ids stay; only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rosterfold.llm.common import prepare, slices, texts
from rosterfold.llm.toxicity import count_toxic
from rosterfold.llm.words import is_space, joined, mix, prefix_hashes, runs, span_hashes

#: Insults that mark abusive text.
INSULTS = (
    "loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid",
)

#: Rules in the order of their bits: a condition on the measurements under which a document fails.
#: Ratios are products, so an empty text divides by nothing.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 2 * n_words",
    "capitals": "n_upper > n_lower",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "huge_word": "longest_word > 1000",
    "few_letters": "10 * n_letter_words < 6 * n_words",
    "insults": "200 * n_insults > n_words",
}

#: Versioned policies: names of the rules that reject a document.
POLICIES = {
    "base_v1": ("few_words", "repeated_words"),
    "web_v1": tuple(r for r in RULES if r != "insults"),
    "web_v2": tuple(RULES),
}

#: Rules on what was learned from labels, and policies that use them.
LEARNED = {"toxic": "100 * n_toxic > n_words"}
LEARNED_POLICIES = {"web_v3": (*POLICIES["web_v2"], *LEARNED)}

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_lower", "longest_word", "n_letter_words", "n_insults",
)

_INSULT = re.compile(rb"(?<![0-9A-Za-z_\x80-\xff])(?:%s)(?![0-9A-Za-z_\x80-\xff])" % "|".join(INSULTS).encode())


def measure(found: list[bytes]) -> dict[str, np.ndarray]:
    """Each measurement of each text."""
    n = len(found)
    data, first, last = joined(found)
    doc = np.repeat(np.arange(n), last - first + 1)
    space = is_space(data)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        """Number of true bytes in each text."""
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[last] - sums[first]

    starts, ends = runs(~space)
    owner = doc[starts]
    out = {"n_words": np.bincount(owner, minlength=n)}
    out["word_chars"] = per_doc(~space & ((data & 0xC0) != 0x80))
    out["n_symbols"] = per_doc(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)))
    # Latin-1 letters in UTF-8 are C3 and 80-9E (capitals) or A0-BE
    after = np.concatenate(([0], data[:-1])) == 0xC3
    upper = ((data >= 65) & (data <= 90)) | (after & (data <= 0x9E) & (data >= 0x80) & (data != 0x97))
    small = ((data >= 97) & (data <= 122)) | (after & (data >= 0x9F) & (data <= 0xBF) & (data != 0xB7))
    out["n_upper"], out["n_lower"] = per_doc(upper), per_doc(small)
    letters = np.concatenate(([0], np.cumsum(upper | small | (data >= 0xC4))))
    out["n_letter_words"] = np.bincount(owner[letters[ends] > letters[starts]], minlength=n)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out["longest_word"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_word"], owner, points[ends] - points[starts])

    sums = prefix_hashes(data)
    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    filled = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    out["n_lines"] = np.bincount(doc[line_end[filled]], minlength=n)
    keys = span_hashes(sums, line_start[filled], line_end[filled])
    _, _, again = _repeats(keys, doc[line_end[filled]])
    out["n_dup_lines"] = np.bincount(doc[line_end[filled]][again], minlength=n)

    words = span_hashes(sums, starts, ends)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        three = mix(mix(mix(words[:-2]) + words[1:-1]) + words[2:])
        whole = np.flatnonzero(owner[:-2] == owner[2:])
        repeated, _, _ = _repeats(three[whole], owner[whole])
        for k in range(3):
            covered[whole[repeated] + k] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n)
    out["n_insults"] = np.array([len(_INSULT.findall(t.lower())) for t in found], np.int64)
    return {name: out[name].astype(np.int64) for name in MEASURES}


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys with the same owner: which occur twice or more, which come first, which come later."""
    both = mix(keys ^ mix(owner.astype(np.uint64)))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    later, repeated = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return repeated, ~later, later


def _measures(docs: DataFrame, markers: np.ndarray | None):
    """Names of the measurements, and a function that makes them of texts; with the toxic words if there are markers."""
    if markers is None:
        return MEASURES, measure
    sent = docs.sparkSession.sparkContext.broadcast(markers)
    return (*MEASURES, "n_toxic"), lambda found: measure(found) | {"n_toxic": count_toxic(found, sent.value)}


def ledger(docs: DataFrame, markers: np.ndarray | None = None) -> DataFrame:
    """doc_id, the measurements, and ``failed``: bit k is set if rule k of ``RULES`` (then ``LEARNED``, given markers) fails."""
    prepare(docs.sparkSession)
    names, measured_by = _measures(docs, markers)

    def evaluate(batches):
        for batch in slices(batches):
            found = measured_by(texts(batch.column("text")))
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(v) for k, v in found.items()})

    columns = ", ".join(f"{m} bigint" for m in names)
    measured = docs.select("doc_id", "text").mapInArrow(evaluate, f"doc_id bigint, {columns}")
    rules = RULES if markers is None else RULES | LEARNED
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, condition in enumerate(rules.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def passing(docs: DataFrame, policy: str, markers: np.ndarray | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the policy keeps; those of ``LEARNED_POLICIES`` need markers."""
    prepare(docs.sparkSession)
    if policy in LEARNED_POLICIES and markers is None:
        raise ValueError(f"policy {policy} needs markers")
    columns = docs.columns
    made, measured_by = _measures(docs, markers)
    names = {m: f"__{m}" for m in made}

    def evaluate(batches):
        for batch in slices(batches):
            found = measured_by(texts(batch.column(columns.index("text"))))
            yield pa.record_batch([*batch.columns, *(pa.array(found[m]) for m in made)], names=[*columns, *names.values()])

    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names.values())])
    fails = " OR ".join(f"({(RULES | LEARNED)[rule]})" for rule in (POLICIES | LEARNED_POLICIES)[policy])
    for name, hidden in names.items():
        fails = re.sub(rf"\b{name}\b", hidden, fails)
    return docs.mapInArrow(evaluate, schema).where(f"NOT ({fails})").select(*columns)


def mask(rules: tuple[str, ...]) -> int:
    """The bits of these rules."""
    names = [*RULES, *LEARNED]
    return sum(1 << names.index(r) for r in rules)


def kept(policy: str) -> Column:
    """Whether a ledger's document passes every rule of the policy."""
    return F.col("failed").bitwiseAND(F.lit(mask((POLICIES | LEARNED_POLICIES)[policy]))) == 0


def ablation(found: DataFrame) -> DataFrame:
    """policy, rule, n_docs, n_failed (by the rule), n_only (rejected by no other rule of the policy).

    The policies of ``LEARNED_POLICIES`` are there if the ledger had markers.
    """
    names = [*RULES, *LEARNED]
    counts = []
    policies = POLICIES | LEARNED_POLICIES if "n_toxic" in found.columns else POLICIES
    for policy, rules in policies.items():
        for rule in rules:
            bit = 1 << names.index(rule)
            hit = F.col("failed").bitwiseAND(F.lit(bit)) != 0
            only = F.col("failed").bitwiseAND(F.lit(mask(rules))) == bit
            counts.append(
                F.struct(
                    F.lit(policy).alias("policy"),
                    F.lit(rule).alias("rule"),
                    F.count(F.lit(1)).alias("n_docs"),
                    F.count_if(hit).alias("n_failed"),
                    F.count_if(only).alias("n_only"),
                )
            )
    return found.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))
