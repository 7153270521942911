"""Operator 10 - secrets by pattern, and by novelty against a primed zstandard dictionary.

Three patterns (assignments, access keys, hex strings) give the base spans. Further candidates are
strings of 16 or more key characters shortly after a sensitive word
(``SENSITIVE``). For each, zstandard, primed with a dictionary of common identifiers, compresses the
text around it with and without the candidate: the marginal bytes say how much of the candidate
neither explains. Names, paths, versions and
repeated values shrink to a few bytes; random keys stay near what random text of their alphabet
and length takes in their place, and are reported as ``novel`` spans. Where sensitive words stand inside a run of key characters, the longest candidate
that is novel counts. Words and numbers of 16 or more characters that nothing explains are novel too:
compression cannot tell them from keys of letters or digits only.

Defined results: null text is empty; repeated rows are scanned one by one; null doc_ids are
returned; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import small_batches

# The base kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_MIN, ACCESS_MIN = 12, 18

SENSITIVE = re.compile(r"(?:passphrase|password|passwd|pwd|secret|token|api[-_ ]?key|access[-_ ]?key|private[-_ ]?key|credential|bearer|authorization)", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]*")
#: Code points between a sensitive word and a candidate; code points of text around a candidate that prime the dictionary.
REACH, AROUND = 48, 512
#: Marginal compressed bytes of a reported candidate, as a share of its bytes or of what random text of its alphabet takes.
NOVELTY = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Usual alphabets of keys, the smallest first.
ALPHABETS = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", _LOWER, _UPPER, f"{_LOWER}234567", f"{_UPPER}234567", f"{_LOWER}0123456789",
             f"{_UPPER}0123456789", f"{_LOWER}{_UPPER}", f"{_LOWER}{_UPPER}0123456789", f"{_LOWER}{_UPPER}0123456789+/_=-"]
_ALPHABETS = [(frozenset(x), x) for x in ALPHABETS]
IDENTIFIERS = (
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ http://www. https:// .com/ .org/ .html index.php?id= example localhost 127.0.0.1 "
    "return function class import from public static void private protected final const string integer boolean undefined null None True False "
    "self.assertEqual __init__ __name__ __main__ getElementById addEventListener toString valueOf console.log System.out.println "
    "username password secret token apikey api_key access_key private_key client_secret client_id authorization bearer credential "
    "config configuration settings environment production development default version release snapshot 2020-01-01 2021 2022 2023 2024 2025 00:00:00 "
    "application/json content-type charset=utf-8 multipart/form-data SELECT FROM WHERE ORDER BY INSERT INTO VALUES UPDATE CREATE TABLE "
    "placeholder changeme your_token_here insert_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 test example sample dummy"
).encode()
_LEVEL = 19


@lru_cache(1024)
def marginal_bytes(candidate: bytes, before: bytes, after: bytes) -> int:
    """What the candidate adds to the compressed size of the text around it, primed with identifiers."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    z = zstandard.ZstdCompressor(level=_LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(z.compress(before + after + candidate)) - len(z.compress(before + after))


@cache
def _random(alphabet: str, size: int) -> bytes:
    """``size`` characters drawn from ``alphabet``, the same ones every time."""
    return "".join(random.Random(alphabet).choices(alphabet, k=size)).encode()


def bound(candidate: str, before: bytes, after: bytes, novelty: float = NOVELTY) -> float:
    """Marginal bytes from which the candidate is novel. Literals take their whole bytes in short texts and their
    entropy in long ones, so random text of the candidate's alphabet is measured in its place."""
    used = frozenset(candidate.rstrip("="))
    alphabet = next(x for have, x in _ALPHABETS if used <= have)
    size = 1 << max(4, (len(candidate) - 1).bit_length())
    return novelty * min(len(candidate), marginal_bytes(_random(alphabet, size)[:len(candidate)], before, after))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of the base spans, sorted."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    return sorted(out)


def _overlapped(taken: list[tuple[int, int]], k: int, a: int, z: int) -> bool:
    """Whether one of the spans ``taken[k:]``, sorted by start, shares a character with [a, z)."""
    for x, y in islice(taken, k, None):
        if x >= z:
            return False
        if a < y:
            return True
    return False


def _longest(text: str, starts: list[int], z: int, novelty: float) -> int | None:
    """Where the longest novel candidate of the run that ends at ``z`` starts. Each piece of the run, from one start
    to the next, is compressed once, after the text before it; a candidate is novel if its first piece is (one that
    is explained, or a sensitive word alone, is a name in front of the key) and if the marginal bytes of all its pieces reach their bounds' sum."""
    found, total, least, after = None, 0, 0.0, text[z:z + AROUND].encode()
    for a, e in zip(reversed(starts), [z, *reversed(starts)]):
        before = text[max(0, a - AROUND):a].encode()
        n, b = marginal_bytes(text[a:e].encode(), before, after), bound(text[a:e], before, after, novelty)
        total, least = total + n, least + b
        if n >= b and total >= least and not SENSITIVE.fullmatch(text[a:e].lstrip("+/_=-")):
            found = a
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Incompressible strings after sensitive words, outside the base spans: of each run of key characters the
    longest, see ``_longest``."""
    starts: dict[int, list[int]] = {}  # end of a run: where its candidates start
    taken = sorted((a, z) for a, _, z in base)
    k = run_end = 0
    for w in SENSITIVE.finditer(text):
        while k < len(taken) and taken[k][1] <= w.end():
            k += 1
        window = min(len(text), w.end() + REACH + 256)
        for m in CANDIDATE.finditer(text, w.end(), window):
            a, z = m.span()
            if a > w.end() + REACH:
                break
            if z == window:  # cut by the window: the run goes on, each run is walked once
                run_end = run_end if z < run_end else RUN.match(text, z).end()
                z = run_end
            if not _overlapped(taken, k, a, z):
                at = starts.setdefault(z, [])
                if not at or a > at[-1]:
                    at.append(a)
    return [(a, 3, z) for z, at in starts.items() if (a := _longest(text, at, z, novelty)) is not None]


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[r]}:{a}:{z}" for a, r, z in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[list[int]] = [[], [], []]
            sha, spans = [], []
            for x in b.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                for r in range(3):
                    n[r].append(sum(1 for _, k, _ in base if k == r))
                sha.append(hashlib.sha256(digest(base).encode()).hexdigest())
                spans.append(digest(sorted(base + novel_spans(text, base))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)
