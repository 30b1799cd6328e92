"""URL filters by a bit-parallel wildcard automaton.

Every rule is a glob over the bytes of a canonical URL: ``*`` stands for any run
of bytes, ``?`` for one.  All rules lie side by side in the bits of a few 64-bit
words; one shift, one AND with the mask of the next byte and one OR of the
states that a ``*`` holds advance every rule over a whole block of URLs at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands between host and path of a canonical URL; no UTF-8 text holds this byte.
EDGE = b"\xff"
#: URLs of one block.
BLOCK_URLS = 8192

# The rules of the contract, and the globs that judge what they leave.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
GLOBS = [
    ("block", "*", "*/login*"), ("block", "*", "*/signin*"), ("block", "*", "*/cart*"), ("block", "*", "*/wp-admin/*"),
    ("block", "*casino*", "*"), ("block", "*porn*", "*"), ("block", "ads.*", "*"), ("block", "*.ads.*", "*"),
    ("block", "*", "*.exe"), ("block", "*", "*.zip"), ("block", "*", "*.jp?g"), ("block", "*", "*.png"),
]


@dataclass(frozen=True)
class Glob:
    pattern: bytes


def host_rule(host: str, path: str) -> Glob:
    """Fits the host and its subdomains if the path starts with ``path``; both are literal."""
    return Glob(b"*." + _literal(host) + EDGE + _literal(path) + b"*")


def glob_rule(host: str, path: str) -> Glob:
    """Fits if both parts match; the host glob sees the host from its first label on."""
    return Glob(b"." + host.encode() + EDGE + path.encode())


def _literal(text: str) -> bytes:
    return b"".join(b"\\" + bytes([b]) if b in b"*?\\" else bytes([b]) for b in text.encode())


class Automaton:
    """The packed masks of a list of globs."""

    def __init__(self, globs: list[Glob]):
        states: list[tuple[int, int]] = []  # rule, byte or -1
        first, holds, floats, accept = [], set(), set(), []
        self.always = np.zeros(len(globs), bool)
        for r, g in enumerate(globs):
            begin, i, lead = len(states), 0, True
            while i < len(g.pattern):
                b = g.pattern[i]
                if b == ord("*"):
                    if lead:
                        floats.add(r)
                    else:
                        holds.add(len(states) - 1)
                elif b == ord("?"):
                    states.append((r, -1))
                    lead = False
                else:
                    if b == ord("\\"):
                        i += 1
                        b = g.pattern[i]
                    states.append((r, b))
                    lead = False
                i += 1
            if len(states) == begin:  # only stars: it fits all
                self.always[r] = True
                floats.discard(r)
                accept.append(-1)
                first.append(-1)
            else:
                first.append(begin)
                accept.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.masks = np.zeros((256, self.words), np.uint64)
        for s, (_, b) in enumerate(states):
            for c in range(256) if b < 0 else (b,):
                self.masks[c, s // 64] |= np.uint64(1 << s % 64)
        self.first = self._bits(x for x in first if x >= 0)
        self.floats = self._bits(first[r] for r in floats)
        self.holds = self._bits(holds)
        self.accept = accept

    def _bits(self, states) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for s in states:
            out[s // 64] |= np.uint64(1 << s % 64)
        return out

    def run(self, urls: list[bytes]) -> np.ndarray:
        """Which rule fits which URL."""
        lengths = np.array([len(u) for u in urls])
        order = np.argsort(-lengths, kind="stable")
        raw = np.frombuffer(b"".join(urls), np.uint8)
        at = (np.cumsum(lengths) - lengths)[order]
        longest = -np.sort(-lengths)
        state = np.zeros((len(urls), self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(longest[0]) if len(urls) else 0):
            live = int(np.searchsorted(-longest, -step, "left"))  # those with more bytes than this
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved &= ~self.first
            moved |= self.first if step == 0 else self.floats
            state[:live] = (moved & self.masks[raw[at[:live] + step]]) | (d & self.holds)
        fits = np.zeros((len(urls), len(self.accept)), bool)
        for r, s in enumerate(self.accept):
            fits[order, r] = True if s < 0 else (state[:, s // 64] >> np.uint64(s % 64)) & one == one
        return fits


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, globs: list[tuple[str, str, str]] | None = None, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    Host and path are canonical: the host lower-cased (A-Z), from the first
    ``://`` to ``/``, ``?``, ``#`` or the end, the path from there to ``?``,
    ``#`` or the end; both empty for a null URL or one without ``://``.  Of the
    host rules that fit the longest wins (the first of equals) and is named by
    ``rule``; with none, the first glob that fits decides, else ``default``.
    URLs of any length are read whole; an empty table gives an empty table;
    repeated rows and rows without an id are judged one by one; other columns are
    not read.
    """
    rules, globs = RULES if rules is None else rules, GLOBS if globs is None else globs
    names = [host + path for _, host, path in rules]
    ranked = sorted(range(len(rules)), key=lambda r: (-len(names[r]), r))
    machine = Automaton([host_rule(rules[r][1], rules[r][2]) for r in ranked] + [glob_rule(h, p) for _, h, p in globs])
    verdicts = np.array([rules[r][0] for r in ranked] + [g[0] for g in globs] + [default], object)
    called = np.array([names[r] for r in ranked] + [None] * (len(globs) + 1), object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_URLS):
                batch = whole.slice(at, BLOCK_URLS)
                hosts, paths = batch.column(1), batch.column(2)
                urls = [b"." + h + EDGE + p for h, p in zip(pc.cast(hosts, pa.binary()).to_pylist(), pc.cast(paths, pa.binary()).to_pylist())]
                fits = np.concatenate([machine.run(urls), np.ones((len(urls), 1), bool)], 1)
                won = fits.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), hosts, paths, pa.array(called[won], pa.string()), pa.array(verdicts[won], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    place = F.instr(url, F.lit("://"))
    rest = F.when(place > 0, F.substr(url, place + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
