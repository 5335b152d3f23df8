"""Text functions: names, scripts, ordered rules, sniffing."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Replacements of the phonetic key, applied in this order.
PHONETIC = (
    ("ksh", "ks"), ("x", "ks"), ("ph", "f"), ("w", "v"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"),
    ("gh", "g"), ("jh", "j"), ("ch", "c"), ("sh", "s"), ("z", "j"), ("q", "k"), ("ck", "k"), ("ee", "i"), ("ii", "i"),
    ("oo", "u"), ("uu", "u"), ("aa", "a"), ("ou", "o"), ("ov", "o"), ("au", "o"), ("ai", "e"), ("ei", "e"),
    ("ay", "e"), ("y", "i"), ("ea", "e"), ("gauda", "goda"), ("govda", "goda"),
)


def once(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often `then` names it: as the element of an array of one."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def phonetic_token(token: Column) -> Column:
    """Spelling variants of one name part fall together; doubled letters collapse; a final a, u or e goes if long."""
    out = F.regexp_replace(F.lower(token), "[^a-z]", "")
    for a, b in PHONETIC:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"(.)\1+", "$1")
    return once(out, lambda out: F.when(F.length(out) > 3, F.regexp_replace(out, "[aue]+$", "")).otherwise(out))


def phonetic_key(name: Column) -> Column:
    """Phonetic forms of the name's tokens of more than one letter, sorted, joined by a space; titles don't count."""
    return F.array_join(F.array_sort(F.transform(F.filter(name_tokens(name), lambda t: F.length(t) > 1), phonetic_token)), " ")


# Titles that aren't part of a name, short forms, and how a last initial is spelled out.
HONORIFICS = ["sri", "shri", "shree", "sree", "smt", "srimati", "shrimati", "mr", "mrs", "ms", "kum", "kumari", "dr", "late", "master", "baby", "janab", "sh"]
EXPANSIONS = {
    "md": "mohammed", "mohd": "mohammed", "mohammad": "mohammed", "muhammad": "mohammed", "mahammad": "mohammed",
    "saiyad": "syed", "sayed": "syed", "sayyed": "syed", "saiyed": "syed",
}
SPELLED_INITIALS = {"es": "s", "ar": "r", "ke": "k", "em": "m", "en": "n", "bi": "b", "di": "d", "ji": "j", "pi": "p", "ti": "t", "vi": "v", "si": "c", "el": "l", "eh": "h", "ech": "h"}


# What stands between a name and a relative's, and between a name and its alias (besides @).
RELATION_WORDS = ["s/o", "d/o", "w/o", "c/o", "son of", "daughter of", "wife of"]
ALIAS_WORDS = ["urf", "alias", "a/k/a", "aka", "ur"]


def _mapped(token: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), token), token)


def name_tokens(name: Column) -> Column:
    """Latin tokens of a name without titles, short forms written out; a spelled initial counts only at the end of several."""
    raw = F.filter(F.split(F.lower(name), "[^a-z]+"), lambda t: t != "")

    def written_out(raw: Column) -> Column:
        n = F.size(raw)
        last = F.transform(raw, lambda t, i: F.struct(t.alias("t"), ((i == n - 1) & (n > 1)).alias("last")))
        kept = F.filter(last, lambda x: ~x["t"].isin(HONORIFICS))
        return F.transform(kept, lambda x: F.when(x["last"], _mapped(_mapped(x["t"], EXPANSIONS), SPELLED_INITIALS)).otherwise(_mapped(x["t"], EXPANSIONS)))

    return once(raw, written_out)


def normalised_name(name: Column) -> Column:
    """struct(primary, initials, aliases, relative) of tokens: "A @ B s/o C" has the name A, the alias B and the relative
    C; initials are the single letters of the name."""
    parts = F.split(name, rf"(?i)\s+(?:{'|'.join(RELATION_WORDS)})\s+", 2)
    none = F.array().cast("array<string>")

    def parsed(primary: Column, names: Column, parts: Column) -> Column:
        return F.struct(
            primary.alias("primary"),
            F.filter(primary, lambda t: F.length(t) == 1).alias("initials"),
            F.transform(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), name_tokens).alias("aliases"),
            F.coalesce(name_tokens(F.get(parts, F.lit(1))), none).alias("relative"),
        )

    def named(parts: Column) -> Column:
        names = F.filter(F.split(F.get(parts, F.lit(0)), rf"(?i)@|\b(?:{'|'.join(ALIAS_WORDS)})\b"), lambda p: F.trim(p) != "")
        return once(names, lambda names: once(F.coalesce(name_tokens(F.get(names, F.lit(0))), none), lambda primary: parsed(primary, names, parts)))

    return once(parts, named)


def reference_key(text: Column) -> Column:
    """Letters and digits only, upper case: how reference numbers are compared."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first rule (pattern, label) that the text matches: one CASE, so later patterns needn't run."""
    (pattern, label), *rest = rules
    out = F.when(F.rlike(text, F.lit(pattern)), label)
    for pattern, label in rest:
        out = out.when(F.rlike(text, F.lit(pattern)), label)
    return out.otherwise(default)


def vote(text: Column, rules: dict[str, Sequence[str]], tie: str = "unknown") -> Column:
    """struct(label, hits): the class with most patterns found; no hit or a tie for first gives `tie`."""
    counts = F.array(*[F.struct(sum((F.rlike(text, F.lit(p)).cast("int") for p in ps), F.lit(0)).alias("hits"), F.lit(k).alias("label")) for k, ps in rules.items()])
    ranked = F.array_sort(counts, lambda a, b: F.when(a["hits"] != b["hits"], b["hits"] - a["hits"]).when(a["label"] < b["label"], -1).otherwise(1))
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    unclear = (top["hits"] == 0) | (second["hits"].isNotNull() & (second["hits"] == top["hits"]))
    return F.struct(F.when(unclear, tie).otherwise(top["label"]).alias("label"), top["hits"].alias("hits"))


def script_of(text: Column) -> Column:
    """Script of the first Indic letter, else latin."""
    first = F.regexp_extract(text, "[\\u0C80-\\u0CFF\\u0900-\\u097F]", 0)
    return F.when(F.rlike(first, F.lit("[\\u0C80-\\u0CFF]")), "kannada").when(first != "", "devanagari").otherwise("latin")


def sniff(content: Column) -> Column:
    """File type of a binary column by its first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head == "25504446", "pdf").when(head == "504B0304", "docx").when(head == "89504E47", "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
        .when(F.rlike(F.lower(F.substring(content, 1, 64).cast("string")), F.lit("^\\s*<(!doctype html|html)")), "html").when(F.is_valid_utf8(content.cast("string")), "text").otherwise("unknown")
    )


# How an answer is written.
YES = ["yes", "y", "done", "ಹೌದು", "हाँ", "obtained", "present"]
NO = ["no", "n", "not done", "ಇಲ್ಲ", "नहीं", "not obtained", "absent", "nil"]
NOT_RECORDED = ["not recorded", "", "-", "blank", "not mentioned", "n/a"]


def yes_no(text: Column) -> Column:
    """not_recorded (also null), no, yes or unclear; tried in this order, by the whole answer or its first word."""
    t = F.rtrim(F.lower(F.trim(text)), F.lit("."))
    head = F.regexp_extract(t, r"^([^\s(,]*)", 1)
    return (
        F.when(t.isNull() | t.isin(NOT_RECORDED), "not_recorded")
        .when(t.isin(NO) | F.startswith(t, F.lit("not ")) | head.isin(NO), "no")
        .when(t.isin(YES) | head.isin(YES), "yes")
        .otherwise("unclear")
    )


def language_mix(text: Column) -> Column:
    """Scripts with more than a tenth of the letters, the largest first, joined by +; none gives unknown."""
    n = F.length(F.regexp_replace(text, r"[^A-Za-z\u0900-\u097F\u0C80-\u0CFF]", ""))
    share = lambda name, letters: F.struct((-F.length(F.regexp_replace(text, f"[^{letters}]", "")) / F.greatest(n, F.lit(1))).alias("s"), F.lit(name).alias("k"))
    found = F.array(share("en", "A-Za-z"), share("hi", r"\u0900-\u097F"), share("kn", r"\u0C80-\u0CFF"))
    mix = F.array_join(F.transform(F.filter(F.array_sort(found), lambda x: x["s"] < -0.1), lambda x: x["k"]), "+")
    return F.when(mix == "", "unknown").otherwise(mix)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; the built-in functions have none. Null if either side is null."""
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _token_set_ratio(a: str, b: str) -> float:
    """The best of the common tokens against each side with them, and of the two sides; 1 if one side holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(t)) for t in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(_indel_ratio(one, two), *([_indel_ratio(both, one), _indel_ratio(both, two)] if both else [0.0]))


def _indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence by both lengths; its length is kept in the bits of one number, a step a letter."""
    if a == b:
        return 1.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = open_ = (1 << len(a)) - 1
    for c in b:
        hit = open_ & at.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & whole
    return 2 * (len(a) - open_.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of the sorted tokens by insertions and deletions, 0 to 1."""
    return pd.Series([None if x is None or y is None else _indel_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of the sets of tokens, 0 to 1: what both share counts with either side."""
    return pd.Series([None if x is None or y is None else _token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


# How the letters of two Indic scripts are written in Latin ones, by their places in the scripts' blocks.
_INDIC = {
    0x02: "n", 0x03: "h", 0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "ch", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x32: "l", 0x33: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h",
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au",
}
_VIRAMA, _VOWEL_SIGNS = 0x4D, range(0x3E, 0x4D)


def _to_latin(text: str) -> str:
    """Devanagari and Kannada letters by place in their blocks, a consonant without a vowel sign with an a; then without
    accents, lower case."""
    out = []
    text = unicodedata.normalize("NFC", text)
    for k, c in enumerate(text):
        block = next((b for b in (0x0900, 0x0C80) if b <= ord(c) < b + 0x80), None)
        if block is None:
            out.append(c)
            continue
        place = ord(c) - block
        after = ord(text[k + 1]) - block if k + 1 < len(text) else -1
        out.append(_INDIC.get(place, ""))
        ends = not 0 <= after < 0x80  # the last consonant of a word keeps no a
        if 0x15 <= place <= 0x39 and after != _VIRAMA and after not in _VOWEL_SIGNS and not ends:
            out.append("a")
    flat = unicodedata.normalize("NFKD", "".join(out))
    return "".join(c for c in flat if not unicodedata.combining(c)).lower()


@F.pandas_udf(T.StringType())
def to_latin(text: pd.Series) -> pd.Series:
    """Text in lower-case Latin letters without accents; Devanagari and Kannada are spelled out. Null stays null."""
    return text.map(lambda t: None if t is None else _to_latin(t))
