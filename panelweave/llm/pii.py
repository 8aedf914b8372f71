"""Surrogates for personal data: keyed, consistent in type, format and script, and distinct.

Entities are found by pattern. Each distinct one (type and normal form) gets a surrogate from a
keyed hash of it: letters stay letters of their script and case, digits stay digits, names keep
their gender's ending, cards their check digit. Collisions with other surrogates or with
any original are found by joins and drawn again, until all are distinct; where forms of the same
length run out, they get one letter or digit longer with each further round. The same entity has one
surrogate everywhere, so mentions of it still belong together.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelweave.llm.common import columns, stored

#: Entity counts up to this number are broadcast with their documents; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rounds in which surrogates keep the length of the original; those of later rounds get longer.
SAME_LENGTH = 16

# Titles by gender (fixed values).
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")

PATTERN = re.compile(
    r"(?P<email>[^\W_][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<secret>(?<![\w/+])(?=[A-Za-z0-9_-]*\d)(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{32,}(?![\w/+]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<card>(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w+])\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}(?!\w))"
    r"|(?P<male>\b(?:" + "|".join(MALE) + r")\b\.? [^\W\d_]\w+(?: (?=[A-ZÀ-ÞА-Я])\w+)?)"
    r"|(?P<female>\b(?:" + "|".join(FEMALE) + r")\b\.? [^\W\d_]\w+(?: (?=[A-ZÀ-ÞА-Я])\w+)?)")
_MAYBE = re.compile(r"[0-9@]|" + "|".join(rf"\b{t}\b" for t in MALE + FEMALE))
KINDS = ("email", "secret", "ip", "card", "phone", "male", "female")


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, in order."""
    if not text or not _MAYBE.search(text):
        return []
    out = []
    for m in PATTERN.finditer(text):
        kind, found, start = m.lastgroup, m.group(), m.start()
        if kind in ("male", "female"):  # the title stays
            cut = found.index(" ") + 1
            found, start = found[cut:], start + cut
            if not found[0].isupper():
                continue
        digits = re.sub(r"\D", "", found)
        normal = digits if kind in ("card", "phone") else found.casefold() if kind in ("email", "male", "female") else found
        out.append((start, start + len(found), kind, normal))
    return out


_RANGES = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


class _Stream:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        self.seed, self.n, self.pool = hmac.new(key, f"{kind}\0{normal}\0{attempt}".encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        v, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return v % n


def _letter(c: str, s: _Stream) -> str:
    script = _script(c)
    if script in _RANGES:
        new = _RANGES[script][s.below(len(_RANGES[script]))]
    elif script == "CJK":
        new = chr(0x4E00 + s.below(0x4000))
    elif script in ("HIRAGANA", "KATAKANA"):
        new = chr((0x3042 if script == "HIRAGANA" else 0x30A2) + s.below(60))
    elif script == "HANGUL":
        new = chr(0xAC00 + s.below(11172))
    else:
        near = _near(c) if c.isalpha() else c
        new = near[s.below(len(near))]
    return new.upper() if c.isupper() and len(new.upper()) == 1 else new


@lru_cache(4096)
def _near(c: str) -> str:
    """Letters of the script, case and block of 64 code points of a letter; Latin ones if it is alone there."""
    at = ord(c) & ~63
    alike = [x for x in map(chr, range(at, at + 64)) if x.isalpha() and _script(x) == _script(c)
             and unicodedata.category(x) == unicodedata.category(c) and (x.casefold() == x or c.casefold() != c)]
    return "".join(alike) if len(alike) > 1 else _RANGES["LATIN"]


def surrogate(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """Surrogate of a normal form, itself a normal form of the same kind and length (hex secrets stay hex).

    From attempt SAME_LENGTH on, names, the local part of addresses, secrets and phones get longer by one sign with
    each attempt, and the numbers of an IP address may have other lengths; cards have at least 10^10 forms.
    """
    s = _Stream(key, kind, normal, attempt)
    extra = max(0, attempt - SAME_LENGTH + 1)
    if kind == "ip" and extra:
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "ip":
        low = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        return ".".join(str(low[len(p)][0] + s.below(low[len(p)][1] - low[len(p)][0] + 1)) for p in normal.split("."))
    if kind == "card":
        new = normal[0] + "".join(str(s.below(10)) for _ in normal[1:])
        for d in "0123456789":
            if _luhn(new[:-1] + d) == _luhn(normal) and (_luhn(normal) or d != normal[-1]):
                return new[:-1] + d
        return new
    if kind == "phone":
        return normal[: max(0, len(normal) - 7)] + "".join(str(s.below(10)) for _ in range(min(7, len(normal)) + extra))
    if kind == "email":
        local, domain = normal.split("@", 1)
        host, top = domain.rsplit(".", 1)
        return "".join(_char(c, s) for c in local + "a" * extra) + "@" + "".join(_char(c, s) for c in host) + "." + top
    if kind == "secret":
        hexed = re.fullmatch("[0-9a-f]+", normal)
        return "".join("0123456789abcdef"[s.below(16)] for _ in range(len(normal) + extra)) if hexed else "".join(_char(c, s) for c in normal + "a" * extra)
    vowels, others = "aeiou", "bdklmnrstv"
    out = []
    for k, word in enumerate(normal.split(" ")):
        word += word[0] * extra if k == 0 else ""
        if _script(word[0]) != "LATIN":
            out.append("".join(_letter(c, s) for c in word))
            continue
        new = [(vowels if i % 2 else others)[s.below(5 if i % 2 else 10)] for i in range(len(word))]
        out.append("".join(new))
    first = out[0]
    if _script(normal[0]) in ("LATIN", "CYRILLIC") and len(first) > 1:  # the given name keeps its gender's ending
        latin = _script(normal[0]) == "LATIN"
        end = ("a" if latin else "а") if kind == "female" else ("nrs" if latin else "нрс")[s.below(3)]
        out[0] = first[:-1] + end
    return " ".join(out)


def _char(c: str, s: _Stream) -> str:
    return str(s.below(10)) if c.isdigit() else _letter(c, s) if c.isalpha() else c


def render(found: str, kind: str, new: str) -> str:
    """The surrogate in the format of a mention: its punctuation for numbers, its case for letters."""
    if kind in ("card", "phone"):
        digits = iter(new)
        return "".join([next(digits, c) if c.isdigit() else c for c in found] + list(digits))
    if kind in ("email", "male", "female") and len(new) == len(found):
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(found, new))
    if kind in ("male", "female"):  # longer than the mention: the case of the last letter goes on
        return " ".join("".join(n.upper() if a[min(i, len(a) - 1)].isupper() and len(n.upper()) == 1 else n for i, n in enumerate(b))
                        for a, b in zip(found.split(" "), new.split(" ")))
    return new


def _assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, new): all surrogates of a kind are distinct, and none is an original.

    Rounds go on until every entity has one: the forms to draw from grow with each round after SAME_LENGTH.
    """
    def run(batches):
        for kind, normal, attempt in columns(batches, "kind", "normal", "attempt"):
            yield pa.RecordBatch.from_pydict({
                "kind": kind, "normal": normal, "attempt": pa.array(attempt, pa.int32()),
                "new": [surrogate(key, k, n, a) for k, n, a in zip(kind, normal, attempt)]})

    done, attempt = None, 0
    waiting = entities.withColumn("attempt", F.lit(0))
    taken = entities.select("kind", F.col("normal").alias("new"))
    while True:
        drawn = waiting.mapInArrow(run, "kind string, normal string, attempt int, new string")
        free = drawn.join(taken, ["kind", "new"], "left_anti")
        won = stored(free.groupBy("kind", "new").agg(F.min("normal").alias("normal")).select("kind", "normal", "new"), "surrogates")
        done = won if done is None else done.unionByName(won)
        left = stored(waiting.join(won, ["kind", "normal"], "left_anti").withColumn("attempt", F.lit(attempt + 1)), "waiting")
        if left.isEmpty():
            return done
        waiting, taken, attempt = left, taken.unionByName(won.select("kind", "new")), attempt + 1


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """Every document with its entities replaced: doc_id, text, n_entities, n_distinct, kinds (sorted).

    A null text stays null and an empty one empty, both without entities. Repeated rows are replaced alike;
    other columns are ignored; an empty table gives an empty result. Titles before names stay, the
    name after them is replaced.
    """
    def per_doc(batches):
        for ids, texts in columns(batches, "doc_id", "text"):
            rows = sorted({(d, k, n) for d, t in zip(ids, texts) for _, _, k, n in mentions(t)})
            d, k, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "kind": pa.array(k, pa.string()), "normal": pa.array(n, pa.string())})

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    keyed = docs.withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("text")))  # without an id, the text stands for it
    # texts are searched once for all that follows; only those with entities are searched again, to be rewritten
    found = stored(keyed.mapInArrow(per_doc, "doc_id long, kind string, normal string"), "found")
    entities = stored(found.select("kind", "normal").distinct(), "entities")
    table = stored(_assign(entities, key), "surrogates")
    named = found.distinct().join(table, ["kind", "normal"])
    each = stored(named.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "normal", "new")).alias("_e")).withColumnRenamed("doc_id", "_k"), "named")
    if each.count() <= BROADCAST_ROWS // 10:
        each = F.broadcast(each)

    def run(batches):
        for ids, texts, known in columns(batches, "doc_id", "text", "_e"):
            out, n, distinct, kinds = [], [], [], []
            for t, e in zip(texts, known):
                new = {(x["kind"], x["normal"]): x["new"] for x in e or ()}
                pieces, last, seen = [], 0, set()
                found = mentions(t) if new else []
                for a, b, k, normal in found:
                    pieces += [t[last:a], render(t[a:b], k, new[k, normal])]
                    last = b
                    seen.add((k, normal))
                out.append("".join([*pieces, t[last:]]) if pieces else t)
                n.append(len(found))
                distinct.append(len(seen))
                kinds.append(sorted({k for k, _ in seen}))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "text": pa.array(out, pa.string()), "n_entities": pa.array(n, pa.int64()),
                "n_distinct": pa.array(distinct, pa.int64()), "kinds": pa.array(kinds, pa.list_(pa.string()))})

    return docs.join(each, F.coalesce("doc_id", F.xxhash64("text")) == F.col("_k"), "left").select("doc_id", "text", "_e").mapInArrow(
        run, "doc_id long, text string, n_entities long, n_distinct long, kinds array<string>")
