"""URL rules in sorted digest arrays.

A rule set is written once to the shared folder: the sorted 64-bit xxhash digests of the rules'
hosts and of their host + path, with the full strings beside them.  Workers memory-map the
arrays, probe whole batches by vectorised binary search, and confirm each hit against the stored
string, so a digest collision decides nothing.

A rule fits its host and all subdomains, where the url's path starts with the rule's path.  The
longest rule (host and path together) wins, of equally long ones the longer host, then `block`.
Defined results: null url or no `://` -> empty host and path, no rule, the default verdict.
Repeated rules count once; a rule listed both ways blocks.  Repeated pages give repeated results; an
empty table or rule set gives no row or no rule.  Columns but page_id and url are not read.  Urls of
any length are judged whole.  All rules are held by the driver while it sorts them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import Scratch, write_array

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ACTIONS = ("allow", "block")
ARRAYS = ("host_digest", "host_at", "host_text", "host_lengths", "length_at", "rule_digest", "rule_at", "rule_text", "rule_action")


def host_and_path(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end].translate(LOWER), rest[end:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host, path[:end]


def digests(strings: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))


def _stored(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by digest, and in that order: digests, where each string begins, all bytes."""
    d = digests(strings)
    order = np.argsort(d, kind="stable")
    at = np.cumsum([0, *(len(strings[i]) for i in order)], dtype=np.int64)
    return order, d[order], at, np.frombuffer(b"".join(strings[i] for i in order), np.uint8)


def build(rules: list[tuple[str, str]], folder: str) -> None:
    """Writes the arrays of rules (action, host/path), such as ("block", "example.com/a/")."""
    action: dict[tuple[str, str], int] = {}
    for what, rule in rules:
        host, slash, path = rule.partition("/")
        key = (host.translate(LOWER), slash + path)
        action[key] = max(action.get(key, 0), ACTIONS.index(what))
    keys = list(action)
    lengths: dict[str, set[int]] = {}
    for host, path in keys:
        lengths.setdefault(host, set()).add(len(path))
    hosts = list(lengths)
    order, host_digest, host_at, host_text = _stored([h.encode() for h in hosts])
    per = [sorted(lengths[hosts[i]]) for i in order]
    rule_order, rule_digest, rule_at, rule_text = _stored([(h + p).encode() for h, p in keys])
    made = {
        "host_digest": host_digest, "host_at": host_at, "host_text": host_text,
        "host_lengths": np.array([n for x in per for n in x], np.int64), "length_at": np.cumsum([0, *map(len, per)], dtype=np.int64),
        "rule_digest": rule_digest, "rule_at": rule_at, "rule_text": rule_text,
        "rule_action": np.array([action[keys[i]] for i in rule_order], np.int8),
    }
    for name in ARRAYS:
        write_array(f"{folder}/{name}.npy", made[name])


class Rules:
    """The arrays, memory-mapped."""

    def __init__(self, folder: str):
        for name in ARRAYS:
            path = f"{folder}/{name}.npy"
            try:
                array = np.load(path, mmap_mode="r")
            except ValueError:  # an empty array can't be mapped
                array = np.load(path)
            setattr(self, name, array)
        self.longest = int(np.diff(self.host_at).max(initial=0))

    def find(self, which: str, strings: list[bytes]) -> np.ndarray:
        """The index of each string among the stored ones, or -1; confirmed byte by byte."""
        stored, at, text = (getattr(self, f"{which}_{x}") for x in ("digest", "at", "text"))
        d = digests(strings)
        lo, hi = np.searchsorted(stored, d, "left"), np.searchsorted(stored, d, "right")
        out = np.full(len(strings), -1)
        for i in np.flatnonzero(hi > lo):
            for k in range(lo[i], hi[i]):
                if text[at[k] : at[k + 1]].tobytes() == strings[i]:
                    out[i] = k
                    break
        return out

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str, int] | None]:
        """The winning rule of each (host, path), and its action."""
        distinct = list(dict.fromkeys(h for h, _ in urls))
        suffixes, of = [], []
        for i, host in enumerate(distinct):
            at = 0
            while at >= 0:
                s = host[at:]
                if len(s) <= self.longest:
                    suffixes.append(s)
                    of.append(i)
                at = host.find(".", at) + 1 or -1
        fits: dict[str, list[tuple[str, np.ndarray]]] = {}
        for s, i, k in zip(suffixes, of, self.find("host", [s.encode() for s in suffixes]), strict=True):
            if k >= 0:
                fits.setdefault(distinct[i], []).append((s, self.host_lengths[self.length_at[k] : self.length_at[k + 1]]))
        tries, owner, size = [], [], []
        for i, (host, path) in enumerate(urls):
            for suffix, lengths in fits.get(host, ()):
                for n in lengths:
                    if n <= len(path):
                        tries.append(suffix + path[:n])
                        owner.append(i)
                        size.append((len(suffix) + int(n), len(suffix)))
        out: list = [None] * len(urls)
        best: dict[int, tuple] = {}
        for rule, i, n, k in zip(tries, owner, size, self.find("rule", [t.encode() for t in tries]), strict=True):
            if k >= 0 and n > best.get(i, (-1, -1)):
                best[i] = n
                out[i] = (rule, int(self.rule_action[k]))
        return out


def filtered(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of pages (page_id, url)."""
    folder = Scratch(pages.sparkSession, "url-filter").local("rules")
    build(rules, folder)
    pages = pages.select("page_id", "url")
    schema = T.StructType([pages.schema["page_id"]])
    for name in ("host", "path", "rule", "verdict"):
        schema.add(name, "string")

    def run(batches):
        mapped = Rules(folder)
        for b in batches:
            urls = [host_and_path(u) for u in b.column("url").to_pylist()]
            found = mapped.judge(urls)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"),
                    pa.array([h for h, _ in urls], pa.string()),
                    pa.array([p for _, p in urls], pa.string()),
                    pa.array([f and f[0] for f in found], pa.string()),
                    pa.array([ACTIONS[f[1]] if f else default for f in found], pa.string()),
                ],
                names=schema.names,
            )

    return pages.mapInArrow(run, schema)
