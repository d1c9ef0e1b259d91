"""Near-duplicate texts by universe partitioning: every pair above a Jaccard threshold, without comparing all.

A text is its set of distinct word shingles. Two sets of sizes x <= y with Jaccard similarity t or more
differ in at most H = (1 - t) / (1 + t) * (x + y) elements. The universe of shingles is cut by hashing
into m segments, m fixed per size band; if the budgets v_i given to a set's segments sum up to more than
H, then in some segment i the two sets differ by less than v_i elements. Budget 1 is met by equal
segments, budget 2 also by segments that are equal after one deletion on either side, so

* each set is entered under a signature of every non-empty segment and of every segment with one element
  deleted, in its own band and in the next one (a partner is at most 1/t times as large);
* each set looks up only the segments it gives a budget to, chosen by an estimate of their postings;
* sets whose budgets cannot sum up (too many empty segments) are met by plain elements instead: any
  (1 - t) * x + 1 elements of such a set hold one of each partner.

Candidates are then verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.hashing import mix as _mix
from notelake.operators.components import connected
from notelake.runtime import broadcast_if_small, cut_lineage, reclaim

THRESHOLD, SHINGLE, MIN_WORDS = 0.6, 3, 20
_U = np.uint64
#: Signatures are 46 bits, two more mark deletion and look-up, 16 hold the set's place in its batch.
_SIG = _U(0xFFFFFFFFFFFC0000)
_DEL, _ASK = _U(1 << 16), _U(1 << 17)
SKETCH = 1 << 20


class Shingler:
    """Sets of hashed word shingles of many texts at once; word hashes are kept between batches up to a bound."""

    def __init__(self, width: int, min_words: int, kept_words: int = 500_000):
        self.width, self.min_words, self.kept_words, self.known = width, min_words, kept_words, {}

    def _hash(self, word: str) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(sizes, elements)``: elements of text 0 in ascending order, then of text 1, ...; texts below min_words have size 0."""
        if len(self.known) > self.kept_words:
            self.known.clear()
        known, lists = self.known, []
        for text in texts:
            words = text.lower().split()
            if len(words) < self.min_words:
                lists.append(())
                continue
            for w in words:
                if w not in known:
                    known[w] = self._hash(w)
            lists.append([known[w] for w in words])
        counts = np.array([len(x) for x in lists])
        flat = np.fromiter((h for x in lists for h in x), _U, int(counts.sum()))
        owner = np.repeat(np.arange(len(lists)), counts)
        n = len(flat) - self.width + 1
        if n < 1:
            return np.zeros(len(texts), np.int64), np.empty(0, _U)
        code = np.zeros(n, _U)
        with np.errstate(over="ignore"):
            for k in range(self.width):
                code = _mix(code * _U(0x9E3779B97F4A7C15) + flat[k : k + n] + _U(k + 1))
        inside = owner[:n] == owner[self.width - 1 :]
        owner, code = owner[:n][inside], code[inside]
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
        return np.bincount(owner[fresh], minlength=len(texts)), code[fresh]


class Scheme:
    """Size bands, segments per band and budgets for one threshold."""

    def __init__(self, threshold: float):
        self.t = threshold
        self.spread = (1 - threshold) / (1 + threshold)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        """Band b holds the sizes from edge(b) to edge(b + 1) - 1."""
        return np.searchsorted(self.edges(int(sizes.max(initial=1))), sizes, side="right") - 1

    def edges(self, largest: int) -> np.ndarray:
        out = [1]
        while out[-1] <= largest:
            out.append(math.floor(out[-1] / self.t + 1e-9) + 1)
        return np.array(out)

    def segments(self, band: np.ndarray) -> np.ndarray:
        """More segments than half the largest size of the band times the spread: budgets must be able to sum up."""
        edges = self.edges(1 << 40)
        top = edges[band + 1] - 1
        share = np.where(top <= 40, 0.7, np.where(top <= 110, 0.4, 0.35)) * (self.spread / 0.25)
        return np.maximum(1, np.ceil(top * share)).astype(np.int64)

    def need(self, sizes: np.ndarray) -> np.ndarray:
        """Budget a set of this size needs against partners that are not larger."""
        return np.floor(self.spread * 2 * sizes + 1e-9).astype(np.int64) + 1


class Signer:
    """Signatures of batches of sets. Estimates of how frequent an element is come from the sets seen so far in this task."""

    def __init__(self, threshold: float):
        self.scheme, self.sketch, self.seen = Scheme(threshold), np.zeros(SKETCH, np.int32), 0

    def entries(self, sizes: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(packed, segments)``: signatures (see _SIG) of sets numbered 0, 1, ... (at most 65,536), and a hash of band and segment of each."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.seen += len(sizes)
        np.add.at(self.sketch, (elements & _U(SKETCH - 1)).astype(np.int64), 1)
        frequency = self.sketch[(elements & _U(SKETCH - 1)).astype(np.int64)]
        band = self.scheme.band(sizes)
        out = [self._in_band(sizes, elements, owner, frequency, band, True), self._in_band(sizes, elements, owner, frequency, band + 1, False)]
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def _in_band(self, sizes, elements, owner, frequency, band, asks: bool) -> tuple[np.ndarray, np.ndarray]:
        m = self.scheme.segments(band)[owner]
        segment = (_mix(elements ^ _U(0xA5A5A5A5DEADBEEF)) % m.astype(_U)).astype(np.int64)
        order = np.lexsort((segment, owner))
        o, s, e, f = owner[order], segment[order], _mix(elements[order]), frequency[order]
        starts = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (s[1:] != s[:-1])]) if len(o) else np.empty(0, np.int64)
        if not len(starts):
            return np.empty(0, _U), np.empty(0, _U)
        size = np.diff(np.r_[starts, len(o)])
        so, ss = o[starts], s[starts]
        with np.errstate(over="ignore"):
            total = np.add.reduceat(e, starts)
            salt = _mix((band[so].astype(_U) << _U(40)) + ss.astype(_U) + _U(1))
            whole = _mix(total + salt)
            many = np.repeat(size > 1, size)
            less = _mix(np.repeat(total + salt, size)[many] - e[many])
        place, segment_of = so.astype(_U), np.repeat(np.arange(len(starts)), size)[many]
        ask_whole, ask_less = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        if asks:
            ask_whole, ask_less = self._budgets(sizes, so, size, f, starts)
        full = (whole & _SIG) | np.where(ask_whole, _ASK, _U(0)) | place
        dropped = (less & _SIG) | _DEL | np.where(ask_less[segment_of], _ASK, _U(0)) | place[segment_of]
        return np.concatenate([full, dropped]), np.concatenate([salt, salt[segment_of]])

    def _budgets(self, sizes, so, size, f, starts) -> tuple[np.ndarray, np.ndarray]:
        """Cheapest budgets that sum up to what each set needs.

        A segment's postings are estimated as if its elements occurred independently: the number of sets
        times the product of the elements' shares. The second unit brings the segments with one element left out.
        """
        share = np.log(np.maximum(f, 1) / max(1, self.seen))
        together = np.add.reduceat(share, starts)
        first_cost = together
        rest = np.repeat(together, size) - share
        # The dearest deletion decides; segments of one element have none.
        second_cost = np.maximum.reduceat(rest, starts)
        units_owner = np.concatenate([so, so[size > 1]])
        cost = np.concatenate([first_cost, second_cost[size > 1]])
        order = np.lexsort((cost, units_owner))
        begin = np.searchsorted(units_owner[order], np.arange(len(sizes)))
        rank = np.arange(len(order)) - begin[units_owner[order]]
        taken = np.zeros(len(order), bool)
        taken[order] = rank < self.scheme.need(sizes)[units_owner[order]]
        first, more = taken[: len(so)], np.zeros(len(so), bool)
        more[size > 1] = taken[len(so) :]
        return first | more, more

    def short(self, sizes: np.ndarray, elements: np.ndarray) -> np.ndarray:
        """Whether all budgets of a set sum up to less than it needs."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        m = self.scheme.segments(self.scheme.band(np.maximum(sizes, 1)))[owner]
        segment = (_mix(elements ^ _U(0xA5A5A5A5DEADBEEF)) % m.astype(_U)).astype(np.int64)
        order = np.lexsort((segment, owner))
        o, s = owner[order], segment[order]
        starts = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (s[1:] != s[:-1])]) if len(o) else np.empty(0, np.int64)
        size = np.diff(np.r_[starts, len(o)])
        sums = np.bincount(o[starts], weights=np.minimum(size, 2), minlength=len(sizes))
        return (sizes > 0) & (sums < self.scheme.need(sizes))


# ----------------------------------------------------------------------------- the join
BITS = 256
#: A batch's sets are numbered in 16 bits.
BATCH = 8192
#: Signatures a task looks through, about; 5 bytes each, besides a record per set that has any there.
ENTRIES_PER_TASK = 24_000_000
#: A task sorts its signatures in slices of this many.
SLICE = 2_000_000
#: From this many parts on, a segment is spread over several.
PARTS_PER_SPLIT = 200
#: Characters a signature stands for, about; only the number of tasks hangs on it.
CHARS_PER_SIGNATURE = 1.6
#: Sets under one signature that a task compares in blocks of this size; the pairs of blocks of more sets are spread over tasks.
BLOCK = 16_384
_RECORD = np.dtype([("id", "<i8"), ("size", "<u4"), ("bits", "<u8", BITS // 64)])


def parity_bits(sizes: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """For each set the parity of its elements in each of BITS cells; two sets differ in at least as many elements as cells."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = (_mix(elements ^ _U(0x5851F42D4C957F2D)) >> _U(56)).astype(np.int64)
    odd = np.bincount(owner * BITS + cell, minlength=len(sizes) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, BITS), axis=1).view("<u8").reshape(-1, BITS // 64)


def _packed(codes: np.ndarray) -> bytes:
    """The low five bytes of each code."""
    return np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


_SIGNED = ["part", "records", "counts", "entries"]


def _sign(threshold: float, width: int, min_words: int, parts: int):
    """Turns each batch of texts into one blob of packed signatures, and of the sets they name, per part.

    A signature is 38 bits, which tell the few million of a part apart, and two marks; the signatures of a set
    follow each other, so only their number is kept beside its record. Sets whose budgets cannot sum up are
    told in rows without signatures: as many elements of each as one of every partner must be among.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer, seen, splits = Shingler(width, min_words), Signer(threshold), set(), max(1, parts // PARTS_PER_SPLIT)
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                ids, texts = [], []
                for i, t in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    if i not in seen:  # copies within a task are signed once
                        seen.add(i)
                        ids.append(i), texts.append(t)
                sizes, elements = shingler.sets(texts)
                if not len(elements):
                    continue
                packed, segment = signer.entries(sizes, elements)
                records = np.zeros(len(sizes), _RECORD)
                records["id"], records["size"], records["bits"] = ids, sizes, parity_bits(sizes, elements)
                # By segment, so that the few signatures a set has in a segment share one copy of its record.
                with np.errstate(over="ignore"):
                    part = (_mix(segment + (packed >> _U(40)) % _U(splits)) % _U(parts)).astype(np.int64)
                place = (packed & _U(0xFFFF)).astype(np.int64)
                order = np.argsort(part * BATCH + place, kind="stable")
                part, place = part[order], place[order]
                codes = ((packed >> _U(26)) << _U(2) | (packed >> _U(16)) & _U(3))[order]
                edges = np.searchsorted(part, np.arange(parts + 1))
                out = []
                for p in range(parts):
                    own = slice(edges[p], edges[p + 1])
                    if edges[p] == edges[p + 1]:
                        continue
                    named, n = np.unique(place[own], return_counts=True)
                    out.append((p, records[named].tobytes(), n.astype("<u4").tobytes(), _packed(codes[own])))
                ends = np.cumsum(sizes)
                for i in np.flatnonzero(signer.short(sizes, elements)):
                    own = elements[ends[i] - sizes[i] : ends[i]]
                    own = own[: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1]
                    out.append((int(i) % parts, records[i : i + 1].tobytes(), own.tobytes(), None))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.binary()) for k in (1, 2, 3))], _SIGNED)

    return sign


#: What a row of a task that looked through its part tells: a pair (a, b), an element a of set b with n elements, or work on block b of signature a.
_PAIR, _ELEMENT, _WORK = 0, 1, 2
_MET = "what int, a bigint, b bigint, n bigint, blob binary"


def _told(what: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, blob: list[bytes] | None = None) -> pa.RecordBatch:
    k = len(a)
    columns = [pa.array(np.full(k, what, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.nulls(k, pa.int64()) if n is None else pa.array(n.astype(np.int64)), pa.nulls(k, pa.binary()) if blob is None else pa.array(blob, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["what", "a", "b", "n", "blob"])


_MEMBER = np.dtype([("record", _RECORD), ("marks", "u1")])


def _compare(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of ids, the smaller first, of members x and y (in step) that marks, sizes and parities do not rule out; y is the one that looks up."""
    ok = ~((x["marks"] & y["marks"] & 2) > 0)
    sx, sy = x["record"]["size"].astype(np.int64), y["record"]["size"].astype(np.int64)
    ok &= (x["record"]["id"] != y["record"]["id"]) & (sx <= sy) & (sx >= threshold * sy - 1e-9)
    x, y, most = x["record"][ok], y["record"][ok], np.floor((1 - threshold) / (1 + threshold) * (sx + sy)[ok] + 1e-9)
    near = np.bitwise_count(x["bits"] ^ y["bits"]).sum(1) <= most
    a, b = x["id"][near], y["id"][near]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def _meet(threshold: float, block: int):
    """All signatures of a part: pairs of a look-up and an entry of the same signature that sizes and parities do not rule out.

    A signature of more than ``block`` sets is not compared here: its members are sent on in pairs of blocks.
    """

    def in_slice(codes: np.ndarray, number: np.ndarray, records: np.ndarray, copied: bool) -> Iterator[pa.RecordBatch]:
        if not len(codes):
            return
        # Look-ups first among the entries of a signature; of a text signed by several tasks one entry per signature and marks.
        marked = codes ^ _U(2)
        order = np.lexsort((number, marked)) if copied else np.argsort(marked)
        codes, number = codes[order], number[order]
        if copied:
            fresh = np.r_[True, (codes[1:] != codes[:-1]) | (number[1:] != number[:-1])]
            codes, number = codes[fresh], number[fresh]
        key, deleted, asks = codes >> _U(2), (codes & _U(1)) > 0, (codes & _U(2)) > 0
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        asking = np.add.reduceat(asks.astype(np.int64), starts)

        def members(at: np.ndarray) -> np.ndarray:
            out = np.empty(len(at), _MEMBER)
            out["record"], out["marks"] = records[number[at]], deleted[at] * 2 + asks[at]
            return out

        for g in np.flatnonzero((size > block) & (asking > 0)):
            own = members(np.arange(starts[g], starts[g] + size[g]))
            name = int(key[starts[g]].astype(np.int64))
            blocks = [own[k : k + block] for k in range(0, len(own), block)]
            for i in range(len(blocks)):
                for j in range(i, len(blocks)):
                    both = blocks[i] if i == j else np.concatenate([blocks[i], blocks[j]])
                    yield _told(_WORK, np.array([name]), np.array([i * len(blocks) + j]), np.array([len(blocks[i])]), [both.tobytes()])
        live = np.flatnonzero((asking > 0) & (size > 1) & (size <= block))
        asker = np.repeat(starts[live], asking[live]) + _count_up(asking[live])
        width, begin = np.repeat(size[live], asking[live]), np.repeat(starts[live], asking[live])
        found, at, ends = [], 0, np.cumsum(width)
        while at < len(asker):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000)))
            y = np.repeat(asker[at:stop], width[at:stop])
            x = np.repeat(begin[at:stop], width[at:stop]) + _count_up(width[at:stop])
            sx, sy = records["size"][number[x]].astype(np.int64), records["size"][number[y]].astype(np.int64)
            ok = (sx <= sy) & (sx >= threshold * sy - 1e-9) & (x != y)
            found.append(_distinct([_compare(members(x[ok]), members(y[ok]), threshold)]))
            at = stop
        pairs = _distinct(found)
        if len(pairs):
            yield _told(_PAIR, pairs[:, 0], pairs[:, 1])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, counts, entries, n = [], [], [], 0
        for batch in batches:
            for r, c, e in zip(*(batch.column(k).to_pylist() for k in ("records", "counts", "entries")), strict=True):
                r = np.frombuffer(r, _RECORD)
                if e is None:
                    own = np.frombuffer(c, _U)
                    yield _told(_ELEMENT, own.view(np.int64), np.full(len(own), r["id"][0]), np.full(len(own), r["size"][0]))
                    continue
                records.append(r), counts.append(np.frombuffer(c, "<u4")), entries.append(e)
                n += len(e) // 5
        if not entries:
            return
        all_records, slices = np.concatenate(records), -(-n // SLICE)
        _, place, same = np.unique(all_records["id"], return_index=True, return_inverse=True)
        first_of, copied = place[same], len(place) < len(all_records)
        for i in range(slices):
            own, who, first = [], [], 0
            for r, c, e in zip(records, counts, entries, strict=True):
                codes = _unpacked(e)
                mine = np.flatnonzero((_mix(codes >> _U(2)) >> _U(32)) % _U(slices) == i) if slices > 1 else np.arange(len(codes))
                own.append(codes[mine]), who.append(np.repeat(np.arange(first, first + len(r)), c)[mine])
                first += len(r)
            yield from in_slice(np.concatenate(own), first_of[np.concatenate(who)], all_records, copied)

    return meet


def _work(threshold: float):
    """Pairs of the blocks of members in ``blob``: of the first ``n`` with the rest, or among all where there is no rest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, n in zip(batch.column("blob").to_pylist(), batch.column("n").to_pylist(), strict=True):
                own = np.frombuffer(blob, _MEMBER)
                sides = [(own, own)] if n == len(own) else [(own[:n], own[n:]), (own[n:], own[:n])]
                found = []
                for askers, others in sides:
                    for y in np.flatnonzero(askers["marks"] & 1):
                        found.append(_compare(others, np.broadcast_to(askers[y], len(others)), threshold))
                    if sum(map(len, found)) > 2_000_000:
                        found = [_distinct(found)]
                pairs = _distinct(found)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return work


def _plain_pairs(rows: DataFrame, lacking: DataFrame, threshold: float, width: int, min_words: int) -> DataFrame:
    """Candidates of the sets in ``lacking`` (element, id, size), joined on plain elements."""

    def elements_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width, min_words)
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                sizes, elements = shingler.sets(batch.column("content").to_pylist())
                ids = batch.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(elements.view(np.int64)), pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(sizes, sizes))], ["element", "other", "other_size"])

    plain = rows.mapInArrow(elements_of, "element bigint, other bigint, other_size bigint")
    sought = broadcast_if_small(lacking, 500_000)
    met = plain.join(sought, "element").filter(f"id <> other and least(size, other_size) >= {threshold} * greatest(size, other_size) - 1e-9")
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0 .. sizes[0] - 1, 0 .. sizes[1] - 1, ..."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _verify(threshold: float, width: int, min_words: int):
    """Keeps the pairs whose shingles, as words, really reach the threshold; a text in several pairs of a batch is cut into shingles once."""

    def shingles(text: str) -> frozenset:
        words = text.lower().split()
        return frozenset(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= min_words else frozenset()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, share, held = [], [], {}
            ids = [batch.column(k).to_pylist() for k in ("a", "b")]
            texts = [batch.column(k) for k in ("text_a", "text_b")]
            for i, pair in enumerate(zip(*ids, strict=True)):
                sets = []
                for side, name in enumerate(pair):
                    if name not in held:
                        if len(held) > 4000:
                            held.clear()
                        held[name] = shingles(texts[side][i].as_py())
                    sets.append(held[name])
                s, t = sets
                both = len(s & t)
                if both and both >= threshold * (len(s) + len(t) - both) - 1e-12:
                    keep.append(i), share.append(both / (len(s) + len(t) - both))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(share, pa.float64())], ["a", "b", "similarity"])

    return verify


def text_ids(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``text_id``, a 64-bit hash of the text; at a billion different texts a clash of two has a chance of about 3 %."""
    return df.withColumn("text_id", F.xxhash64(F.col(text).cast("string")))


def similar_texts(df: DataFrame, text: str = "content", threshold: float = THRESHOLD, width: int = SHINGLE, min_words: int = MIN_WORDS,
                  tasks: int | None = None, block: int = BLOCK) -> DataFrame:
    """``a, b, similarity``: text ids a < b of all pairs of different texts with Jaccard similarity >= threshold.

    Words stand between white space, in lower case; texts of fewer than ``min_words`` words, null ones
    included, take no part. No candidate is dropped: signatures find every such pair, sizes and parities
    rule out only pairs that cannot reach the threshold, and the rest is verified on the words.
    """
    rows = text_ids(df.select(F.col(text).cast("string").alias("content")), "content").select(F.col("text_id").alias("id"), "content")
    rows = rows.filter(f"length(content) >= {2 * min_words - 1}")
    chars = rows.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    tasks = tasks or max(6, -(-int(chars / CHARS_PER_SIGNATURE) // ENTRIES_PER_TASK))
    signed = rows.mapInArrow(_sign(threshold, width, min_words, tasks), "part int, records binary, counts binary, entries binary")
    met = cut_lineage(signed.repartitionById(tasks, "part").mapInArrow(_meet(threshold, block), _MET))
    del signed
    reclaim(df.sparkSession)  # the signatures are the largest thing this job writes
    found = met.filter(f"what = {_PAIR}").select("a", "b")
    others = {r.what: r.n for r in met.groupBy("what").agg(F.count("*").alias("n")).collect()}
    if others.get(_WORK):
        spread_out = met.filter(f"what = {_WORK}").select("a", "b", "n", "blob").repartition(min(others[_WORK], 4000), "a", "b")
        found = found.unionByName(spread_out.select("n", "blob").mapInArrow(_work(threshold), "a bigint, b bigint"))
    if others.get(_ELEMENT):
        lacking = met.filter(f"what = {_ELEMENT}").select(F.col("a").alias("element"), F.col("b").alias("id"), F.col("n").alias("size")).distinct()
        found = found.unionByName(_plain_pairs(rows, lacking, threshold, width, min_words))
    candidates = cut_lineage(found.distinct())  # read three times below
    involved = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = rows.join(broadcast_if_small(involved, 1_000_000), "id", "left_semi").groupBy("id").agg(F.first("content").alias("content"))
    with_a = candidates.join(texts.select(F.col("id").alias("a"), F.col("content").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("content").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_verify(threshold, width, min_words), "a bigint, b bigint, similarity double")


#: Classes of exact copies up to this many keys are written out as all pairs; a larger class as its smallest key with each other one.
ALL_PAIRS = 200


def similar_keys(df: DataFrame, keys: list[str], text: str = "content", threshold: float = THRESHOLD, width: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """``<key>_a, <key>_b`` for each key column: pairs of different keys whose texts are similar, the smaller key first.

    Rows of one key count once. Keys with the same text form a class; pairs of classes and pairs within a
    class are written out in full while a class has at most ALL_PAIRS keys. A larger class of exact copies
    stands as its smallest key with each other member (membership) and meets other classes by that key.
    """
    rows = text_ids(df.select(*keys, F.col(text).cast("string").alias("content")), "content").filter(f"length(content) >= {2 * min_words - 1}")
    pairs = cut_lineage(similar_texts(df, text, threshold, width, min_words).select("a", "b"))
    # Only keys of texts that are in a pair, or on more than one row, can be in the result: the rest ends here.
    repeated = rows.groupBy("text_id").agg(F.count("*").alias("n")).filter("n > 1").select("text_id")
    wanted = cut_lineage(repeated.unionByName(pairs.select(F.explode(F.array("a", "b")).alias("text_id"))).distinct())
    kept = rows.join(broadcast_if_small(wanted, 1_000_000), "text_id", "left_semi")
    members = cut_lineage(kept.select(*keys, "text_id").distinct())
    key = F.struct(*keys)
    classes = members.groupBy("text_id").agg(F.count("*").alias("size"), F.min(key).alias("first"))
    copied = cut_lineage(classes.filter("size > 1"))
    enough = kept.select("text_id", "content").join(broadcast_if_small(copied.select("text_id"), 1_000_000), "text_id", "left_semi").dropDuplicates(["text_id"]).mapInArrow(_long_enough(min_words), "text_id bigint")
    copied = copied.join(enough, "text_id", "left_semi")
    small, big = copied.filter(f"size <= {ALL_PAIRS}").select("text_id"), copied.filter(f"size > {ALL_PAIRS}").select("text_id", "first")
    m = members.select("text_id", key.alias("k"))
    within = m.join(small, "text_id")
    inside = within.select("text_id", F.col("k").alias("ka")).join(within.select("text_id", F.col("k").alias("kb")), "text_id").filter("ka < kb").select("ka", "kb")
    star = m.join(big, "text_id").filter("first < k").select(F.col("first").alias("ka"), F.col("k").alias("kb"))
    # Members that stand for their class in pairs with other classes: all, or only the first of a large class.
    stand = m.join(big.select("text_id", F.col("first").alias("only")), "text_id", "left").filter("only is null or k = only").select("text_id", "k")
    ka = pairs.join(stand.select(F.col("text_id").alias("a"), F.col("k").alias("ka")), "a")
    across = ka.join(stand.select(F.col("text_id").alias("b"), F.col("k").alias("kb")), "b").select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))
    out = inside.unionByName(star).unionByName(across)
    return out.select(*[F.col(f"{side}.{c}").alias(f"{c}_{side[1]}") for side in ("ka", "kb") for c in keys]).select(*[f"{c}_a" for c in keys], *[f"{c}_b" for c in keys])


def _long_enough(min_words: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [i for i, t in zip(batch.column("text_id").to_pylist(), batch.column("content").to_pylist(), strict=True) if len(t.lower().split()) >= min_words]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["text_id"])

    return keep


def duplicate_groups(df: DataFrame, keys: list[str], text: str = "content", threshold: float = THRESHOLD, width: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """``<keys>, group_id, links, group_texts``: one row per key that takes part.

    ``group_id`` is the smallest text id connected by similar pairs (its own where there is none),
    ``links`` the number of other different texts similar to its own, ``group_texts`` the number of
    different texts of the group. Null and short texts get no row.
    """
    pairs = cut_lineage(similar_texts(df, text, threshold, width, min_words).select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("text_id")).groupBy("text_id").agg(F.count("*").alias("links"))
    roots = connected(pairs).withColumnRenamed("id", "text_id")
    sizes = roots.groupBy("root").agg(F.count("*").alias("group_texts"))
    known = roots.join(sizes, "root").join(links, "text_id")
    rows = text_ids(df.select(*keys, F.col(text).cast("string").alias("content")), "content").filter(f"length(content) >= {2 * min_words - 1}")
    taking = rows.dropDuplicates(keys).mapInArrow(_taking(min_words), f"{', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in keys)}, text_id bigint")
    return taking.join(known, "text_id", "left").select(*keys, F.coalesce("root", "text_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_texts", F.lit(1)).alias("group_texts"))


def _taking(min_words: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array([i for i, t in enumerate(batch.column("content").to_pylist()) if len(t.lower().split()) >= min_words], pa.int64())
            names = [n for n in batch.schema.names if n != "content"]
            yield pa.RecordBatch.from_arrays([batch.column(n).take(at) for n in names], names)

    return keep
