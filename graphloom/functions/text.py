"""String functions as columns; pandas UDFs only where no built-in says it."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

#: Agencies whose name may stand before a regulation's.
AGENCIES = ("easa", "faa", "icao", "iso", "nist", "sae")
#: Legal forms and articles that an organisation's short names leave out.
LEGAL = ("inc", "ltd", "llc", "gmbh", "ag", "sa", "corp", "co", "plc")
ARTICLES = ("the", "a", "an")


def normalised(c: Column) -> Column:
    """Lower case; what is no letter a-z, digit or space becomes a space; single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def without_agency(c: Column) -> Column:
    return normalised(F.regexp_replace(c, rf"(?i)^({'|'.join(AGENCIES)})[\s-]+", ""))


def stemmed(c: Column, suffixes: Sequence[str], least: int = 3) -> Column:
    """Each token without the first suffix of the list that it ends with and that leaves ``least`` letters."""

    def one(t: Column) -> Column:
        out = t
        for s in reversed(suffixes):
            out = F.when(t.endswith(s) & (F.length(t) >= len(s) + least), F.substring(t, F.lit(1), F.length(t) - len(s))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(c, " "), one), " ")


def organisation(c: Column) -> Column:
    """Dots go, ``&`` stays, other non-word characters become a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\.", ""), r"(?U)[^\w&]+", " "))


def short_names(c: Column) -> Column:
    """The significant words of a name, and their initials where there are two or more."""
    words = F.filter(F.split(organisation(c), " "), lambda w: ~w.isin(*LEGAL, *ARTICLES) & (w != ""))
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.array_compact(F.array(F.array_join(words, " "), F.when(F.size(words) >= 2, initials)))


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    """Without diacritics (NFKD, combining marks dropped)."""
    import unicodedata

    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (len a + len b), by bit-parallel longest common subsequences; 1 for two empty strings."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        return 2 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def common_subsequence(x: str, y: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, ch in enumerate(x):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for ch in y:
        u = row & at.get(ch, 0)
        row = (row + u | row - u) & full
    return len(x) - row.bit_count()


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of lower-case words."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (a, b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def term_score(text: Column, terms: Sequence[str]) -> Column:
    """Occurrences of the terms over the number of words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: w.isin(*terms))) / F.size(words))


#: Patterns of personal data, and how sure a match is.
PERSONAL = (
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.99),
    ("PASSPORT", r"\b[A-Z]{1,2}\d{7,9}\b", 0.85),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.98),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", 0.90),
    ("PHONE_INTL", r"\+\d{1,3}[\s-]\d[\d\s\-]{6,14}\d", 0.85),
    ("IP_V4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.80),
    ("IP_V6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.90),
    ("CC", r"(?<!\d)(\d[ -]?){13,19}(?!\d)", 0.75),
    ("NATIONAL_ID", r"\b[A-Z]{2}\d{6,10}\b", 0.60),
)


def redacted(c: Column, least: float = 0.80) -> Column:
    """Personal data of the classes that are sure enough as [CLASS_REDACTED], the surest class first; JVM-side.

    Where matches of two classes overlap, the surer one is replaced and the other is looked for in what is left;
    personal_spans() resolves overlaps by position instead.
    """
    for kind, pattern, sure in sorted(PERSONAL, key=lambda p: -p[2]):
        if sure >= least:
            c = F.regexp_replace(c, pattern, f"[{kind}_REDACTED]")
    return c


@F.pandas_udf(ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("stop", IntegerType()).add("confidence", DoubleType())))
def personal_spans(texts: pd.Series) -> pd.Series:
    """Matches of 0.80 and more from left to right; of those that overlap, the one that starts first, then the surest."""
    import re

    made = [(kind, re.compile(pattern), sure) for kind, pattern, sure in PERSONAL if sure >= 0.80]

    def one(t: str | None) -> list[dict]:
        found = sorted((m.start(), -sure, m.end(), kind) for kind, p, sure in made for m in p.finditer(t or ""))
        out, end = [], 0
        for start, unsure, stop, kind in found:
            if start >= end:
                out.append({"kind": kind, "start": start, "stop": stop, "confidence": -unsure})
                end = stop
        return out

    return texts.map(one)


#: What leaves the house is labelled in this order.
EGRESS = (
    (r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,4}\b", "[CARD_REDACTED]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]"),
    (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE_REDACTED]"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL_REDACTED]"),
)


def egress(c: Column) -> Column:
    """Cards, social security and phone numbers and mail addresses as labels."""
    for pattern, label in EGRESS:
        c = F.regexp_replace(c, pattern, label)
    return c


#: Phrases that try to take over a prompt.
INJECTIONS = (
    r"ignore\s+(previous|above|all)\s+instructions?",
    r"disregard\s+(previous|above|all)\s+instructions?",
    r"forget\s+(previous|above|all)\s+instructions?",
    r"system\s+prompt",
    r"reveal\s+(the\s+)?prompt",
    r"show\s+(me\s+)?(the\s+)?prompt",
    r"repeat\s+(the\s+)?instructions?",
)


def guarded(c: Column) -> Column:
    """Phrases that try to take over a prompt as [FILTERED]."""
    for pattern in INJECTIONS:
        c = F.regexp_replace(c, f"(?i){pattern}", "[FILTERED]")
    return c


def fixed_chunks(c: Column, size: int, overlap: int) -> Column:
    """Substrings of ``size`` characters, each ``size - overlap`` after the one before; the last ends with the text."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(c) - overlap) / step) - 1).cast("int"))
    return F.transform(starts, lambda i: F.substring(c, i * step + 1, F.lit(size)))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")


def doc_codes(c: Column) -> Column:
    """Codes of upper-case parts such as FAA-AD-2024."""
    return F.regexp_extract_all(c, F.lit(r"\b([A-Z]{2,}(?:-[A-Z0-9]+){1,4})\b"), F.lit(1))


def hash_bucket(key: Column) -> Column:
    """0 to 1 from the first 32 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295


def pair_id(a: Column, b: Column) -> Column:
    """The same id for (a, b) and (b, a)."""
    return F.sha2(F.array_join(F.array_sort(F.array(a, b)), "\u001f"), 256)


def chapters_of(c: Column) -> Column:
    """The numbers that a list such as ``1,3-5`` names, each once."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+(?:-\d+)?)"), F.lit(1))
    span = lambda p: F.sequence(F.element_at(F.split(p, "-"), 1).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.array_distinct(F.flatten(F.transform(parts, span)))


#: Ordered rules of a question's kind; the first of which a phrase occurs wins.
KINDS = (
    ("contradiction", ("conflict", "contradict", "disagree", "match")),
    ("multi_hop", ("regulatory path", "regulatory hierarchy", "full compliance story", "full supersession chain", "airlines are affected", "operators are affected")),
    ("relational", ("how does", "connected", "relationship", "between")),
    ("multi_hop", ("across", "multiple", "compare", "steps", "chain")),
    ("negative", ("is there", "any evidence")),
)
#: How a kind is answered: mode, rows, and what to do where that fails.
PLANS = {"factoid": ("local", 5, "hybrid"), "relational": ("hybrid", 8, "agentic"), "contradiction": ("hybrid", 8, "review"), "multi_hop": ("global", 10, "agentic"), "negative": ("hybrid", 10, "review")}


def query_kind(c: Column) -> Column:
    """contradiction, multi_hop, relational, negative or factoid; phrases are looked for anywhere, also inside words."""
    t, out = F.lower(c), F.lit("factoid")
    for kind, phrases in reversed(KINDS):
        any_of = F.lit(False)
        for p in phrases:
            any_of = any_of | t.contains(p)
        out = F.when(any_of, kind).otherwise(out)
    return out


def query_plan(c: Column) -> Column:
    """struct(kind, mode, top_k, fallback) of a question."""
    kind = query_kind(c)
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, p in PLANS.items() for x in (k, p[i])]), kind)
    return F.struct(kind.alias("kind"), pick(0).alias("mode"), pick(1).alias("top_k"), pick(2).alias("fallback"))


#: Openings count as near from this ratio on.
NEAR = 0.85


@F.pandas_udf(StringType())
def opening(t: pd.Series) -> pd.Series:
    """The first 300 normalised characters."""
    import re

    return pd.Series([re.sub(r"\s+", " ", (x or "").lower()).strip()[:300] for x in t])


def near_texts(left: list[str], right: list[str]) -> list[tuple[str, str, float, float]]:
    """(x, y, ratio of x and y, ratio of y and x): pairs of unlike openings of which one ratio of matching blocks is NEAR at least;
    each pair once where both lists are the same.

    Matching blocks are a common subsequence of at least NEAR / 2 of both lengths, so a place of one text is matched near the same
    place of the other. Longest common subsequences of x with many y are counted in that band at once, in 64 bits a word, and a y
    is left as soon as its places so far can't be those of such a subsequence.
    """
    import difflib

    out: list[tuple[str, str, float, float]] = []
    if not left or not right:
        return out
    same = left is right
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
    left = sorted(left, key=lambda t: (len(t), t))
    right = left if same else sorted(right, key=lambda t: (len(t), t))
    code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.unique(np.concatenate([code(t) for t in (left if same else left + right)]))
    size, words = np.array([len(t) for t in right]), 1 + max(len(left[-1]), len(right[-1])) // 64
    ys = np.full((max(1, size.max()), len(right)), len(letters), np.int64)
    for c, t in enumerate(right):
        ys[: len(t), c] = np.searchsorted(letters, code(t))
    for k, x in enumerate(left):
        n = len(x)
        bits = np.zeros((len(letters) + 1, 64 * words), bool)
        bits[np.searchsorted(letters, code(x)), np.arange(n)] = True
        mask = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T)
        first = np.searchsorted(size, math.floor(n * NEAR / (2 - NEAR)) - 1)
        first, stop = max(first, k + 1) if same else first, np.searchsorted(size, math.ceil(n * (2 - NEAR) / NEAR) + 1, "right")
        for at in range(first, stop, 4096):
            part = slice(at, min(stop, at + 4096))
            out += [(x, right[c], xy, yx) for c in _alike(mask, n, ys[:, part], size[part], at) if x != right[c] and max(xy := ratio(x, right[c]), yx := ratio(right[c], x)) >= NEAR]
    return out


def _alike(mask: np.ndarray, n: int, y: np.ndarray, m: np.ndarray, at: int) -> list[int]:
    """Those of the texts from ``at`` on (y: their letters, m: their lengths) whose longest common subsequence with one of n letters (mask: words, letters) can reach NEAR."""
    some, need, one = np.arange(at, at + len(m)), NEAR / 2 * (n + m) - 1e-9, np.uint64(1)
    fits = need <= np.minimum(n, m)
    if not fits.all():
        some, m, need, y = some[fits], m[fits], need[fits], y[:, fits]
        if not len(some):
            return []
    v = np.full((len(mask), len(some)), ~np.uint64(0))
    high, low = int((n - need).max()) + 1, int((m - need).max()) + 1  # how far a match lies ahead and back of its place at most
    for i in range(int(m.max())):
        carry = None
        for w in range(max(0, (i - low) // 64), min(len(mask) - 1, (i + high) // 64) + 1):
            hit = mask[w][y[i]]
            u = v[w] & hit
            total = v[w] + u
            over = total < u
            if carry is not None:
                total += carry
                over |= total < carry
            v[w] = total | (v[w] ^ u)
            carry = over.astype(np.uint64)
        if i % 32 == 31 and i > 64:
            done = np.minimum(i + 1, m)
            keep, below, w = np.zeros(len(some), bool), np.zeros(len(some), np.int64), 0
            start = max(0, i + 1 - low - 32) // 16 * 16
            for j in range(start, min(n, i + 1 + high + 16) + 16, 16):  # the places up to j - 1 have so many matches
                while 64 * (w + 1) <= j and w < len(mask):
                    below = below + np.bitwise_count(~v[w])
                    w += 1
                part = np.bitwise_count(~v[w] & ((one << np.uint64(j - 64 * w)) - one)) if w < len(mask) else 0
                keep |= below + part >= np.maximum(done - (m - need), min(n, max(0, j - 16)) - (n - need))
            if 4 * keep.sum() < 3 * len(keep):
                some, m, need, y, v = some[keep], m[keep], need[keep], y[:, keep], v[:, keep]
                if not len(some):
                    return []
    return some[np.bitwise_count(~v).sum(axis=0) >= need].tolist()


def cross_score(text: Column, question: str) -> Column:
    """A stand-in for a cross-encoder: 0.5 for the phrase; for each term that occurs 0.1, and 0.05 for each of its
    neighbours in the question that occurs, too; 0.8 of it for texts of under 20 or over 500 words; 1 at most. Null is empty."""
    t, terms = F.lower(F.coalesce(text, F.lit(""))), question.lower().split()
    score = F.when(t.contains(question.lower()), 0.5).otherwise(0.0)
    has = [t.contains(w) for w in terms]
    for i in range(len(terms)):
        near = F.lit(0.0)
        for j in (i - 1, i + 1):
            if 0 <= j < len(terms):
                near = near + F.when(has[j], 0.05).otherwise(0.0)
        score = score + F.when(has[i], 0.1 + near).otherwise(0.0)
    n = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.least(F.lit(1.0), score * F.when((n < 20) | (n > 500), 0.8).otherwise(1.0))


#: How a text cites.
CITED = (r"\[Source:([^\]]+)\]", r"\(Document ([^\)]+)\)", r"according to ([^,\.]+)", r"as mentioned in ([^,\.]+)", r"per ([^,\.'\"]+)'s")
#: Marks of document ids, and titles of people.
DOC_MARKS, TITLES = ("DOC-", "MED-", "LAB-"), ("Dr.", "Doctor", "Nurse", "Prof.")


def citations(c: Column) -> Column:
    """What a text cites, pattern by pattern; a citation that is made twice is listed twice."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(1)) for p in CITED])
    return F.transform(found, lambda x: F.trim(x))


def citation_state(cited: Column, known: Column, sources: Column) -> Column:
    """verified, unverified, fake_doc or fake_person: ids must stand in the sources' text or be ``known`` ids, people must be
    named in it, anything else must occur in it in any case."""

    def one_of(marks: Sequence[str]) -> Column:
        out = F.lit(False)
        for m in marks:
            out = out | cited.contains(m)
        return out

    doc = F.when(sources.contains(cited) | F.array_contains(known, cited), "verified").otherwise("fake_doc")
    person = F.when(sources.contains(cited), "verified").otherwise("fake_person")
    other = F.when(F.lower(sources).contains(F.lower(cited)), "verified").otherwise("unverified")
    return F.when(one_of(DOC_MARKS), doc).when(one_of(TITLES), person).otherwise(other)


#: A heading line is a Markdown heading, a numbered title, or a title in capitals.
HEADING = r"^(#{1,6}\s+.+|\d{1,2}\.\s+[A-Z][A-Z0-9 &/,'\"().-]{1,60}|[A-Z][A-Z0-9 &/,'\"()—-]{1,68}:?)\s*$"


def parts_of(text: str, size: int, overlap: int, marks: Sequence[str] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest of the marks that a text has; finer marks only inside a
    part that is too long. A piece begins with the last parts of the one before, up to ``overlap`` characters."""
    mark = next(m for m in marks if m in text)
    rest = marks[marks.index(mark) + 1 :]
    units: list[str] = []
    for u in text.split(mark) if mark else list(text):
        units += parts_of(u, size, overlap, rest) if len(u) > size and rest else [u] if u else []
    out, held = [], []
    length = lambda us: sum(map(len, us)) + len(mark) * max(0, len(us) - 1)
    for u in units:
        if held and length([*held, u]) > size:
            out.append(mark.join(held).strip())
            while held and (length(held) > overlap or length([*held, u]) > size):
                held.pop(0)
        held.append(u)
    return [p for p in [*out, mark.join(held).strip()] if p]


#: Texts whose chunks are in memory at once.
TEXTS = 64


def section_chunks(df, key: str, text: str, label: Column, size: int = 512, overlap: int = 64, soft: float = 1.6):
    """(key, chunk, heading, body): sections begin at heading lines (what is before the first has none); one of more than
    ``soft * size`` characters is cut into parts that each begin with its heading; ``[label]`` stands before every chunk.
    Null and blank texts have no chunk. Chunks count from 0."""
    import re

    head, most = re.compile(HEADING), soft * size

    def cut(t: str | None) -> list[tuple[str, str]]:
        sections, out = [("", [])], []
        for line in (t or "").split("\n"):
            if head.match(line):
                sections.append((line.strip(), []))
            sections[-1][1].append(line)
        for heading, lines in sections:
            body = "\n".join(lines).strip()
            if body:
                for p in [body] if len(body) <= most else parts_of(body, size, overlap):
                    out.append((heading, p if not heading or p.startswith(heading) else f"{heading}\n\n{p}"))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):  # the chunks of some texts at once
                b = whole.slice(at, TEXTS)
                found = [cut(t) for t in b.column(2).to_pylist()]
                of = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                flat = [c for f in found for c in f]
                columns = [pa.array([i for f in found for i in range(len(f))], pa.int32()), pa.array([h for h, _ in flat], pa.string()), pa.array([x for _, x in flat], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *columns], [key, "_label", "chunk", "heading", "_body"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(key, label.cast("string").alias("_label"), text).mapInArrow(run, f"`{key}` {kind}, _label string, chunk int, heading string, _body string")
    return out.select(key, "chunk", "heading", F.concat(F.lit("["), F.coalesce("_label", F.lit("")), F.lit("]\n\n"), F.col("_body")).alias("body"))


#: Frequent short words of four languages.
STOP_WORDS = {"de": ("der", "die", "und", "das", "mit"), "en": ("the", "of", "and", "that", "with"), "es": ("de", "que", "los", "para", "por"), "fr": ("le", "la", "et", "des", "pour")}


def stop_word_language(text: Column) -> Column:
    """The language with most of its frequent words in a text, the first by name on a tie; null where there are none."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    def found(own: tuple) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*own)))

    ranked = [(lang, found(own)) for lang, own in sorted(STOP_WORDS.items())]
    most = F.greatest(*[n for _, n in ranked])
    out = F.lit(None).cast("string")
    for lang, n in reversed(ranked):
        out = F.when(n == most, lang).otherwise(out)
    return F.when(most > 0, out)


def cache_key(question: Column, *settings: Column) -> Column:
    """SHA-256 of a question without regard to case and spacing, with its settings."""
    return F.sha2(F.concat_ws("\u001f", F.trim(F.regexp_replace(F.lower(question), r"\s+", " ")), *settings), 256)


#: Forms of a reading query, and words that no reading query has.
READS = ("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
WRITES = ("SERVICE", "LOAD", "INSERT", "DELETE", "CLEAR", "DROP", "CREATE", "ADD", "MOVE", "COPY")


def read_only(c: Column) -> Column:
    """Whether a graph query only reads, and only here: it has a reading form and none of the words that write or call
    another server. Comments and literals don't count. Null reads nothing: false."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"#[^\n]*", ""), r""" "(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*' """.strip(), '""'))
    word = lambda ws: rf"\b({'|'.join(ws)})\b"
    return bare.rlike(word(READS)) & ~bare.rlike(word(WRITES))
