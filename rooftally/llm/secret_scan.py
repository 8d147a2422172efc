"""Secrets in texts: fixed patterns, and a conditional random field over tokens that adds to them (operator 12).

The field tags tokens as begin, inside or outside by their shape, by neighbouring words and by traits of the whole text, and Viterbi decodes
the tags. It is trained here: on excerpts of at most ``SAMPLE`` documents, in which what the patterns find is tagged, with made-up secrets and
lookalikes (addresses, versions, identifiers, digests' short forms, …) set in at random, so that it also learns forms which the patterns don't know.

Scale: finding is a narrow map over the texts, without a shuffle; the model (under a megabyte) is fitted once in one task. Every token is judged, plain
words and numbers too. Where outside leads by more than the transitions could make up for, the chain is cut, and the runs between are decoded. A task
takes the texts of about a megabyte together: their distinct words are cut into tokens once, and the traits of new tokens are taken in arrays.

Defined cases: NULL and empty texts have no secrets. Texts are searched whole, whatever their length. Patterns are leftmost and
don't overlap within a kind; spans of the field that lie inside a pattern's span are left out, others stay beside it. Repeated rows stay and
each get the same answer; an empty table trains a field that finds nothing. Extra columns are kept by ``find_secrets`` and otherwise ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rooftally.llm.secret_tagger import BEGIN, INSIDE, OUTSIDE, TOKEN, Tagger, train

#: Documents that the field is fitted on at most, and characters of an excerpt.
SAMPLE, EXCERPT = 1500, 1200
#: Tokens of a training sequence at most.
WINDOW = 40
SEED = 12
#: Characters of texts that a task looks at together.
PORTION = 1 << 20
# The patterns, the kinds in their order and the least lengths.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 or more; shorter ones would be dropped
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Bytes as 0 if they are hex digits, else as a space, and 16 digits so written.
HEX_BYTES, HEX_LEAST = bytes(48 if chr(b) in "0123456789abcdef" else 32 for b in range(256)), b"0" * 16
KINDS = ("assign", "access", "hex", "tagged")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find, by start and then kind: (kind, start, end) in code points."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if HEX_LEAST in text.encode("utf-8", "surrogatepass").translate(HEX_BYTES):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def all_spans(text: str | None, tagger: Tagger) -> list[tuple[str, int, int]]:
    """The patterns' spans and those that the field adds."""
    return spans_of([text], tagger)[0]


def spans_of(texts: list[str | None], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Of each text, the patterns' spans and those that the field adds."""
    texts = [t or "" for t in texts]
    out = []
    for text, tagged in zip(texts, tagger.spans_of(texts)):
        base = base_spans(text)
        more = [("tagged", a, b) for a, b in tagged if not any(s <= a and b <= e for _, s, e in base)]
        out.append(sorted(base + more, key=_order) if more else base)
    return out


def portions(texts: list[str | None], letters: int = PORTION) -> Iterator[list[str | None]]:
    """Neighbouring texts of at most so many characters together, or one longer text."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size > letters and k > first:
            yield texts[first:k]
            first, size = k, len(text or "")
    if first < len(texts):
        yield texts[first:]


# --- training data ------------------------------------------------------------------------------------------------
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_MIXED = _LOWER + _UPPER + _DIGIT


def _text(rng: np.random.Generator, letters: str, least: int, most: int) -> str:
    return "".join(letters[k] for k in rng.integers(0, len(letters), int(rng.integers(least, most + 1))))


def _mixed(rng: np.random.Generator, letters: str, least: int, most: int) -> str:
    """Letters and digits both."""
    while True:
        out = _text(rng, letters, least, most)
        if sum(c.isdigit() for c in out) >= 2 and sum(c.isalpha() for c in out) >= 2:
            return out


def _secret(rng: np.random.Generator) -> tuple[str, str, str]:
    """(before, secret, after) of a made-up secret."""
    kind = int(rng.integers(0, 9))
    word = str(rng.choice(["password", "passwd", "pwd", "secret", "token", "api key", "apikey", "access key", "client_secret", "credential", "auth"]))
    joint = str(rng.choice([" = \"", ": ", "=", " is ", ": '", " ", " := "]))
    close = joint[-1] if joint[-1] in "\"'" else ""
    if kind == 0:
        return word + joint, _mixed(rng, _MIXED, 16, 44), close
    if kind == 1:
        return word + joint, _mixed(rng, _MIXED + "+/", 28, 64), close
    if kind == 2:
        return word + joint, str(rng.choice(["ghp_", "gho_", "sk-", "pk_live_", "xoxb-", "glpat-", "AIza"])) + _mixed(rng, _MIXED, 20, 40), close
    if kind == 3:
        return "Authorization: Bearer ", ".".join(_mixed(rng, _MIXED + "_", 20, 40) for _ in range(3)), ""
    if kind == 4:
        lines = "\n".join(_mixed(rng, _MIXED + "+/", 40, 64) for _ in range(int(rng.integers(2, 6))))
        return "-----BEGIN PRIVATE KEY-----\n", lines, "\n-----END PRIVATE KEY-----"
    if kind == 5:
        return word + joint, "AKIA" + _text(rng, _UPPER + _DIGIT, 14, 18), close
    if kind == 6:
        return word + joint, _mixed(rng, "0123456789abcdef", 24, 64), close
    if kind == 7:
        return word + joint, _mixed(rng, _UPPER + _DIGIT, 16, 32), close
    return "", _mixed(rng, _MIXED, 24, 48), ""


def _lookalike(rng: np.random.Generator) -> str:
    """Text that has something of a secret and is none."""
    name, other = _text(rng, _LOWER, 5, 14), _text(rng, _LOWER, 4, 12)
    number = lambda a, b: _text(rng, _DIGIT, a, b)
    return [lambda: f"{name}.{number(1, 3)}@{other}.example.com", lambda: f"https://{name}.example.org/{other}/{number(1, 6)}",
            lambda: ".".join(number(1, 3) for _ in range(4)), lambda: f"+{number(1, 2)} ({number(3, 3)}) {number(3, 3)}-{number(4, 4)}",
            lambda: number(5, 19), lambda: f"{name}{other.title()}{_text(rng, _LOWER, 3, 9).title()}", lambda: f"{name}_{other}_{number(1, 3)}",
            lambda: f"v{number(1, 2)}.{number(1, 2)}.{number(1, 3)}-{other}", lambda: f"20{number(2, 2)}-{number(2, 2)}-{number(2, 2)}T{number(2, 2)}",
            lambda: f"src/{name}/{other}.py", lambda: name + other + name, lambda: (name + other).upper(), lambda: f"{name}-{other}-{name}-{other}",
            lambda: f"{name}{number(1, 4)}", lambda: f"password must be {other}", lambda: f"the token {name} {other}", lambda: f"secret: {name}",
            lambda: f"{number(1, 3)},{number(3, 3)},{number(3, 3)}.{number(2, 2)}", lambda: _text(rng, "0123456789abcdef", 6, 11)][int(rng.integers(0, 19))]()


def training_sequences(texts: list[str], seed: int = SEED) -> list[tuple[list[str], list[int], str]]:
    """(words, tags, text) from excerpts: windows as they are, with a lookalike, or with a made-up secret set in between two words."""
    rng = np.random.default_rng(seed)
    out = []
    for text in texts:
        for turn in range(4):
            gaps = [0, *(m.end() for m in re.finditer(r"\s", text))]
            at = gaps[int(rng.integers(0, len(gaps)))]
            changed, hidden = text, []
            if turn in (0, 1):
                before, secret, after = _secret(rng)
                changed = text[:at] + before + secret + after + " " + text[at:]
                hidden = [(at + len(before), at + len(before) + len(secret))]
            elif turn == 2:
                changed = text[:at] + _lookalike(rng) + " " + _lookalike(rng) + " " + text[at:]
            hidden += [(a, b) for _, a, b in base_spans(changed) if not changed[a:b].isdigit()]
            found = [(m.start(), m.end()) for m in TOKEN.finditer(changed)]
            middle = next((k for k, (a, b) in enumerate(found) if b > at), 0)
            first = max(0, middle - int(rng.integers(4, WINDOW // 2)))
            words, tags, old = [], [], None
            for a, b in found[first:first + WINDOW]:
                own = next((h for h in hidden if h[0] < b and a < h[1] and _secret_part(changed, a, b, h)), None)
                tags.append(OUTSIDE if own is None else INSIDE if own == old else BEGIN)
                words.append(changed[a:b])
                old = own
            out.append((words, tags, changed))
    return out


def _secret_part(text: str, a: int, b: int, span: tuple[int, int]) -> bool:
    """Whether a token within a span belongs to the secret itself: of an assignment, its value."""
    m = ASSIGN.match(text, span[0])
    return a >= m.start(1) if m and m.end() == span[1] else True


def fit_tagger(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Tagger:
    """The field for a corpus, fitted in one task on excerpts of at most ``sample`` documents, which are chosen by hash."""
    key, known = F.xxhash64(text), docs.filter(F.col(text).isNotNull())
    # the hashes are chosen before any text moves
    last = known.select(key.alias("key")).distinct().orderBy("key").limit(sample).agg(F.max("key").alias("last")).first().last
    place = F.pmod(F.xxhash64(F.lit(1), F.col(text)), F.greatest(F.lit(1), F.char_length(text) - EXCERPT)).cast("int") + 1
    chosen = known.filter(key <= F.lit(last).cast("long"))
    some = chosen.select(key.alias("key"), F.substring(F.col(text), place, F.lit(EXCERPT)).alias("t")).groupBy("key").agg(F.min("t").alias("t"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"key": [], "t": []}), *batches]).sort_values(["key", "t"], kind="stable")
        yield pd.DataFrame({"model": [pickle.dumps(train(training_sequences(rows["t"].tolist())))]})

    fit = some.coalesce(1).mapInPandas(fitted, "model binary").first()
    return pickle.loads(fit["model"]) if fit else train([])  # an empty table may have no task


# --- the operator ---------------------------------------------------------------------------------------------------
def secrets(tagger: Tagger, text: Column) -> Column:
    """All spans of a text, sorted by start and then kind."""
    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        rows = (spans for part in portions(texts.to_pylist()) for spans in spans_of(part, tagger))
        return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in rows], _ARROW)

    return found(text)


def find_secrets(docs: DataFrame, tagger: Tagger, text: str = "text", name: str = "secrets") -> DataFrame:
    """The documents with a column of spans (kind, start, end); ``end`` is exclusive, in code points."""
    return docs.withColumn(name, secrets(tagger, F.col(text)))


def secret_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from documents with ``secrets``."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)

    base = F.filter("secrets", lambda s: s["kind"] != "tagged")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("secrets")).alias("spans"))
