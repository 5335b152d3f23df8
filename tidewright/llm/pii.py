"""Personal data: base patterns, and terms that reveal protected entities by corpus co-occurrence."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import named, save, small

KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: A run of digits is taken whole (possessive) and only from its start, so that no run is scanned once for each digit.
_PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Credentials, which are protected entities too: keys of a known form, and values with a digit that a label announces.
_KEY = re.compile(r"\b(?:(AKIA|ASIA)[0-9A-Z]{16}|(ghp_|gho_|glpat-|sk_live_|xox[abp]-)[A-Za-z0-9-]{16,})(?![A-Za-z0-9])")
_LABELLED = re.compile(r"(?i:(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\w{0,16})[\"']?\s{0,2}[=:]\s{0,2}[\"']?(?=[^\s\"']{0,200}[0-9])([A-Za-z0-9+/_.~=@!#$%^&*-]{8,})")
_LABEL = re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Words on each side of a base span that count as its surroundings.
CONTEXT = 8
#: Distinct texts in which a term must stand near the entity; share of the entity's information that a term may give.
SUPPORT, DISCLOSURE = 3, 0.9
#: A term that gives this share or more is removed, one below is generalised.
REMOVAL = 0.999
#: Terms that are broadcast at most (about 20 MB as a set); beyond it the same comes from a shuffled join.
MOST_TERMS = 200_000


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in found.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    if kind == "card":
        digits = "".join(_DIGIT.findall(found))
        return 14 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 10 <= len(_DIGIT.findall(found)) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Leftmost addresses: what may stand before an @, back to the last match, then the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((a, end, "email"))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed; matches that fail their test are dropped.

    The time grows with the length of the text, whatever it holds.
    """
    kinds = []
    if _DIGIT.search(text):
        kinds = ["ip"] * ("." in text) + ["card"] + ["phone"] * ("+" in text)
    spans = [(m.start(), m.end(), k) for k in kinds for m in _PATTERNS[k].finditer(text) if _passes(k, m[0])]
    return _in_order((_emails(text) if "@" in text else []) + spans)


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of credentials, not overlapping: keys of a known form, then labelled values."""
    if not _DIGIT.search(text):
        return []
    found = [(*m.span(), "secret") for m in _KEY.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(2), "secret") for m in _LABELLED.finditer(text)]
    out, end = [], 0
    for a, b, k in sorted(found):
        if a >= end:
            out.append((a, b, k))
            end = b
    return out


def _in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Disjoint ranges that the spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _surroundings(found: list[tuple[int, int, str]], a: int, b: int) -> set[str]:
    """The CONTEXT words before and after a span; `found` are the text's words with their places."""
    before, after = bisect_right(found, a, key=lambda w: w[1]), bisect_left(found, b, key=lambda w: w[0])
    return {w.lower() for _, _, w in (*found[max(0, before - CONTEXT) : before], *found[after : after + CONTEXT])}


def _names(text: str, a: int, b: int, kind: str) -> tuple[str, str]:
    """The entity, and what it shares with others: mail domain, network, issuer of a card, area of a phone number, the
    first letters of a key or the label of another credential."""
    found = text[a:b].lower()
    digits = "".join(_DIGIT.findall(found)) if kind in ("card", "phone") else ""
    if kind == "secret":
        label = _LABELLED.match(text, m.start()) if (m := _LABEL.search(text, max(0, a - 40), a)) else None
        shared = label[1].lower() if label and label.start(2) == a else found[:4] + "*"
    else:
        shared = {"email": found[found.rfind("@") :], "ip": ".".join(found.split(".")[:2]) + ".*", "card": digits[:6] + "*", "phone": "+" + digits[:4] + "*"}[kind]
    return f"{kind}:{found}", f"{kind} of {shared}"


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows for each base span or credential: the entity or its group, the text it stands in and the terms around it."""
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = base_spans(text) + secret_spans(text)
            found = [(*m.span(), m[0]) for m in _WORD.finditer(text)] if spans else []
            for a, b, k in spans:
                near = sorted(_surroundings(found, a, b))
                out += [(e, key, near) for e in _names(text, a, b, k)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["entity", "text_key", "terms"])


def words_in(text: str) -> set[str]:
    """The text's words as terms, found in the text as it is and lower-cased then, as everywhere here."""
    return set(_WORD.findall(text.lower())) if text.isascii() else {w.lower() for w in _WORD.findall(text)}


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first column, term) for each of a text's words, a few texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            rows = [(x, w) for x, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for w in words_in(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], batch.column(0).type), pa.array([w for _, w in rows], pa.string())], names=[batch.schema.names[0], "term"])


def _frequencies(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, n): in how many distinct texts of docs (weight, text) each of `terms` stands; c copies weigh 1 / c each."""
    if n_terms <= MOST_TERMS:
        wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: Counter = Counter()
            for batch in batches:
                for weight, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for w in wanted.value.intersection(words_in(text)) if wanted.value else ():
                        n[w] += weight
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.float64())], names=["term", "weight"])

        counted = docs.select("weight", "text").mapInArrow(run, "term string, weight double")
    else:
        counted = docs.select("weight", "text").mapInArrow(_exploded, "weight double, term string").join(terms, "term", "left_semi")
    return counted.groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("n"))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """(term, action) over docs (text without nulls): terms whose pointwise mutual information with an entity is
    at least DISCLOSURE of that entity's information content, both estimated over all documents. Entities are exact values, and the groups that values share (_names).

    PMI(e, t) = ln(n_et N / (n_e n_t)) and IC(e) = ln(N / n_e). Documents with the same text count once in all four
    numbers, so that copies are no evidence.
    """
    texts = save(docs.groupBy(F.xxhash64("text").alias("text_key")).agg(F.count(F.lit(1)).alias("copies")), "texts")
    copied = texts.where("copies > 1")
    found = save(docs.select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(_entities, "entity string, text_key long, terms array<string>"), "entities")
    n_entity = found.groupBy("entity").agg(F.count_distinct("text_key").alias("n_e"))
    near = found.select("entity", "text_key", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count_distinct("text_key").alias("n_et")).where(F.col("n_et") >= SUPPORT)
    near = save(near.join(n_entity, "entity"), "near")
    terms = near.select("term").distinct()
    n_terms = terms.count()
    total = texts.count()
    weighed = docs.withColumn("text_key", F.xxhash64("text")).join(small(copied, copied.count()), "text_key", "left").select((1 / F.coalesce("copies", F.lit(1))).alias("weight"), "text")
    n_term = _frequencies(weighed, terms, n_terms)
    pmi = F.log(F.col("n_et") * F.lit(total) / (F.col("n_e") * F.col("n")))
    share = pmi / F.log(F.lit(total) / F.col("n_e"))
    scored = near.join(n_term, "term").where(F.col("n_e") < total).groupBy("term").agg(F.max(share).alias("share")).where(F.col("share") >= DISCLOSURE)
    return scored.select("term", F.when(F.col("share") >= REMOVAL, "remove").otherwise("generalise").alias("action"))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, n_term long, base_spans string, spans string, sanitised string"


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, base_spans and spans (kind:start:end, code points), sanitised.

    Base kinds and credentials are replaced by [EMAIL], [IP], [CARD], [PHONE] and [SECRET]; a disclosing term, wherever it stands outside
    these, is generalised to [TERM] or removed. Overlapping spans are replaced together, under the first kind.
    Null and empty texts have no spans and an empty sanitised text. An empty table gives no rows; repeated rows
    repeat; other columns are ignored. Of ties, spans with the same start, the kind listed first comes first.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    terms = save(disclosing_terms(rows), "terms")
    shared = None
    if terms.count() <= MOST_TERMS:
        shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["action"] for r in terms.collect()})
    else:  # each distinct text gets its own terms
        rows = rows.withColumn("text_key", F.xxhash64("text"))
        held = rows.select("text_key", "text").mapInArrow(_exploded, "text_key long, term string").distinct().join(terms, "term")
        held = held.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions"))
        rows = rows.join(held, "text_key", "left").select("doc_id", "text", "actions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        actions = shared.value if shared else {}
        known = frozenset(actions)
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if not shared:
                    actions = dict(batch.column(2)[k].as_py() or ())
                    known = frozenset(actions)
                base, more, action = base_spans(text), secret_spans(text), {}
                n = Counter(k for _, _, k in base)
                n["secret"] = len(more)
                if known and known.intersection(words_in(text)):
                    taken = _joined_spans(base + more)
                    for m in _WORD.finditer(text):
                        if (w := m[0].lower()) in known:
                            at = bisect_right(taken, m.start(), key=lambda s: s[1])  # the first that ends behind the word's start
                            if at == len(taken) or taken[at][0] >= m.end():
                                more.append((m.start(), m.end(), "term"))
                                action[m.start()] = actions[w]
                n["term"] = len(action)
                spans = _in_order(base + more)
                clean, at = [], 0
                for a, b, k in spans:
                    if a >= at:
                        clean += [text[at:a], "" if action.get(a) == "remove" and k == "term" else f"[{k.upper()}]"]
                    at = max(at, b)
                out.append((*(n[k] for k in KINDS), joined(base), joined(spans), "".join(clean) + text[at:] if spans else None))
            columns = list(zip(*out, strict=True)) or [[]] * 9
            types = [pa.int64()] * 6 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), batch.column(1)], names=[*(x.split()[0] for x in SCHEMA.split(", ")), "text"])

    return rows.mapInArrow(run, SCHEMA + ", text string").withColumn("sanitised", F.coalesce("sanitised", "text")).drop("text")
