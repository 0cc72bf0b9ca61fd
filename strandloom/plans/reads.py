"""Reads of many fragments at once: places, qualities and errors as arrays, tasks' batches at a time.

A read without an inserted or deleted stretch, whose template lies in one aligned run of
its haplotype, is a row of an array. The few others go through ``with_errors`` one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa

from strandloom.functions.sequence import BASES

#: Bases of the haplotype beyond a read's length that deletions may use up.
SPARE = 20
#: Fragments that are worked on at once.
AT_ONCE = 4096

#: Numbers of XXH64, as the algorithm fixes them.
P1, P2, P3, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Code of each base in BASES, 4 for all other signs; and for each base the three others in order.
CODES = np.full(256, 4, np.int64)
CODES[[ord(b) for b in BASES]] = range(4)
OTHERS = np.array([[ord(b) for b in BASES if b != x] for x in BASES], np.uint8)


def xxhash_int(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of 32-bit numbers, each with its seed: what Spark's xxhash64 does with a further int column."""
    x = seeds.view(np.uint64) + P5 + np.uint64(4)
    x ^= values.astype(np.uint32).astype(np.uint64) * P1
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * P2 + P3
    x = (x ^ (x >> np.uint64(33))) * P2
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> np.uint64(32))


def hashed_at(keys: np.ndarray, salt: int, columns: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on key, salt and column only."""
    x = keys.astype(np.uint64) + (columns.astype(np.uint64) + np.uint64(1 + (salt << 20))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def hashed_uniform(keys: np.ndarray, salt: int, n: int) -> np.ndarray:
    """(len(keys), n) such numbers."""
    return hashed_at(keys[:, None], salt, np.arange(n)[None, :])


def quality_chains(keys: np.ndarray, model) -> np.ndarray:  # noqa: ANN001
    """(reads, length) qualities of a Markov chain that starts at the best one."""
    q = np.array(model.qualities)
    n = len(q)
    u = hashed_uniform(keys, 1, model.length)
    if model.chain is not None:
        first, moves = model.chain  # (n,), (places, n, n); a read longer than the model is stretched over it
        out = np.empty((len(keys), model.length), np.int64)
        state = np.minimum((u[:, :1] >= np.cumsum(first)[None, :]).sum(1), n - 1)
        for k in range(model.length):
            if k:
                at = min(len(moves) - 1, (k - 1) * len(moves) // max(1, model.length - 1))
                state = np.minimum((u[:, k, None] >= np.cumsum(moves[at], axis=1)[state]).sum(1), n - 1)
            out[:, k] = q[state]
        return out
    move = u >= model.stay
    move[:, 0] = False
    row, column = np.nonzero(move)
    drawn = np.full(u.shape, n - 1)
    drawn[row, column] = np.minimum((hashed_at(keys[row], 2, column) * n).astype(int), n - 1)
    since = np.maximum.accumulate(np.where(move, np.arange(model.length), 0), axis=1)
    return q[np.take_along_axis(drawn, since, 1)]


def slice_cigar(runs: list[tuple[int, str]], off: int, length: int) -> tuple[int, list[str]]:
    """Reference offset and one operation for each step (M, I or D) of haplotype bases off .. off + length."""
    ref = hap = 0
    begin, out = None, []
    for n, op in runs:
        if op == "D":
            if off < hap < off + length:
                out += ["D"] * n
            ref += n
            continue
        first, last = max(off, hap), min(off + length, hap + n)
        if first < last:
            if begin is None:
                begin = ref + (first - hap if op == "M" else 0)
            out += [op] * (last - first)
        hap += n
        ref += n if op == "M" else 0
        if hap >= off + length:
            break
    return (begin if begin is not None else ref), out


def compact(ops: list[str]) -> str:
    out, last, n = [], "", 0
    for op in [*ops, ""]:
        if op == last:
            n += 1
            continue
        if n:
            out.append(f"{n}{last}")
        last, n = op, 1
    return "".join(out)


def with_errors(template: str, ops: list[str], q: np.ndarray, u: np.ndarray, v: np.ndarray, model) -> tuple[str, list[str]]:  # noqa: ANN001
    """``length`` read bases with sequencing errors, and their operations.

    A base errs with the probability its quality states. Errors are substitutions or,
    never side by side and not at the ends, inserted or deleted stretches; bases that a
    deletion uses up come from the template's spare ones, and none is made without them.
    """
    n, seq, out = model.length, [], []
    sizes, longest, spare = model.error_lengths[0], max(model.error_lengths[0]), len(template) - n
    shares = np.cumsum(model.error_lengths[1]) / sum(model.error_lengths[1])
    steps = iter(zip(template, [o for o in ops if o != "D"], strict=False))
    gaps: dict[int, int] = {}
    at = 0
    for o in ops:
        if o == "D":
            gaps[at] = gaps.get(at, 0) + 1
        else:
            at += 1
    used, last = 0, -9
    chance = np.minimum(1.0, model.error_scale * 10.0 ** (-q / 10.0))
    err = u < chance

    def taken() -> tuple[str, str]:
        nonlocal used, out
        if seq:
            out += ["D"] * gaps.get(used, 0)
        used += 1
        return next(steps, ("N", "M"))

    while len(seq) < n:
        base, op = taken()
        k = len(seq)
        if err[k] and k != last and base in BASES:  # a deletion leaves k as it is, and has spent its error
            kind = v[k]
            if kind < model.indel_error and 0 < k < n - 1 - longest and k - last > 1:
                size = sizes[min(int((u[k] / chance[k] >= shares).sum()), len(sizes) - 1)]
                if kind < model.indel_error * model.insertion_error:
                    last = k
                    seq += [base, *(BASES[(int(u[k] * 1e6) >> (2 * i)) % 4] for i in range(size))]
                    out += [op] + ["I"] * size
                    spare += size
                    continue
                if size <= spare:
                    last = k
                    spare -= size
                    for i in range(size):
                        gone = op if i == 0 else taken()[1]
                        out += ["D"] * (gone == "M")
                    continue
            seq.append([b for b in BASES if b != base][int(kind * 997) % 3])
        else:
            seq.append(base)
        out.append(op)
    return "".join(seq[:n]), out


class Alignments:
    """Haplotypes' CIGARs, and where their aligned runs lie, all on one line."""

    ROOM = 1 << 32

    def __init__(self, cigars: list[str]) -> None:
        self.runs = [[(int(n), op) for n, op in re.findall(r"(\d+)([MID])", c)] for c in cigars]
        found = []
        for i, runs in enumerate(self.runs):
            hap, ref = i * self.ROOM, 0
            for n, op in runs:
                if op == "M":
                    found.append((hap, hap + n, ref))
                hap += n if op != "D" else 0
                ref += n if op != "I" else 0
        self.starts, self.ends, self.refs = np.array(found, np.int64).reshape(-1, 3).T

    def place(self, rows: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Reference offsets of stretches that lie in one aligned run, else -1."""
        if not len(self.starts):
            return np.full(len(rows), -1)
        at = rows * self.ROOM + off
        run = np.maximum(np.searchsorted(self.starts, at, "right") - 1, 0)
        inside = (self.starts[run] <= at) & (at + size <= self.ends[run])
        return np.where(inside, self.refs[run] + at - self.starts[run], -1)


def made_reads(model, keys: np.ndarray, swap: np.ndarray, start: np.ndarray, rows: np.ndarray, alignments: Alignments, data: np.ndarray, sides: list[tuple[np.ndarray, ...]]) -> dict[str, pa.Array]:  # noqa: ANN001
    """Columns of the reads of fragments, both of one side by side: mate, pos, cigar, seq, qual, flag, mapq, mate_pos, tlen.

    For each side, which is read from its far end if it is the second, ``sides`` has where
    in ``data`` the template lies, how long it is, and where in the haplotype it begins.
    """
    n, total = model.length, len(keys)
    each = len(sides)
    longest = max(model.error_lengths[0])
    table = np.minimum(1.0, model.error_scale * 10.0 ** (-np.arange(int(max(model.qualities)) + 1) / 10.0))
    inner = (np.arange(n) > 0) & (np.arange(n) < n - 1 - longest)
    pos, lost = np.empty((total, each), np.int64), np.zeros((total, each), bool)
    seq, qual = np.empty((total, each, n), np.uint8), np.empty((total, each, n), np.uint8)
    cigars = np.full((total, each), f"{n}M", object)
    for s, (at, size, off) in enumerate(sides):
        own = keys + np.uint64(s * 7919)
        q, u = quality_chains(own, model), hashed_uniform(own, 3, n)
        place = alignments.place(rows, off, size)
        first = at if s == 0 else at + size - n
        plain = (place >= 0) & (size >= n)
        index = np.where(plain, first, 0)[:, None] + np.arange(n)
        template = data[np.minimum(index, len(data) - 1)]
        if s:
            template = template[:, ::-1]
        code = CODES[template]
        wrong = (u < table[q]) & (code < 4)
        row, column = np.nonzero(wrong)
        kind = hashed_at(own[row], 4, column)
        plain[row[(kind < model.indel_error) & inner[column]]] = False
        read = template.copy()
        read[row, column] = OTHERS[code[row, column], (kind * 997).astype(np.int64) % 3]
        pos[:, s] = start + place + (size - n if s else 0)
        slow = np.flatnonzero(~plain)
        v = hashed_uniform(own[slow], 4, n)
        for i, k in enumerate(slow):
            runs = alignments.runs[rows[k]]
            text = data[at[k] : at[k] + size[k]].tobytes().decode("latin-1")
            ref, ops = slice_cigar(runs, int(off[k]), len(text))
            whole = ops
            text, ops = with_errors(text[::-1] if s else text, ops[::-1] if s else ops, q[k], u[k], v[i], model)
            if s:
                ref += sum(o != "I" for o in whole) - sum(o != "I" for o in ops)
            read[k] = np.frombuffer(text.encode("latin-1"), np.uint8)
            pos[k, s], lost[k, s], cigars[k, s] = start[k] + ref, "M" not in ops, compact(ops[::-1] if s else ops)
        seq[:, s], qual[:, s] = (read[:, ::-1], q[:, ::-1]) if s else (read, q)
    if model.mask_below is not None:
        seq[qual <= model.mask_below] = ord("N")
    second = np.zeros((total, 1), bool)
    flag = np.where(swap[:, None], 16, 0) + 4 * lost
    tlen, mate_pos = np.zeros((total, each), np.int64), None
    if each == 2:
        second = np.stack([swap, ~swap], 1)
        flag = 1 + np.where(second, 128, 64) + np.array([32, 16]) + 8 * lost[:, ::-1] + 2 * ~lost.any(1, keepdims=True) + 4 * lost
        span = np.where(lost.any(1), 0, pos[:, 1] - pos[:, 0] + n)
        tlen = np.stack([span, -span], 1)
        one = lost.sum(1) == 1  # the one without a place stands where its mate does
        pos[one] = pos[one, np.argmin(lost[one], 1)][:, None]
        mate_pos = pa.array(pos[:, ::-1].ravel())
    texts = [fixed_strings(x) for x in (seq, qual + np.uint8(33))]
    columns = [pa.array(np.where(second, 2, 1).ravel().astype(np.int32)), pa.array(pos.ravel()), pa.array(cigars.ravel(), pa.string()), *texts, pa.array(flag.ravel().astype(np.int32)), pa.array(np.where(lost, 0, 70).ravel().astype(np.int32))]
    columns += [pa.nulls(total * each, pa.int64()) if mate_pos is None else mate_pos, pa.array(tlen.ravel())]
    return dict(zip(("mate", "pos", "cigar", "seq", "qual", "flag", "mapq", "mate_pos", "tlen"), columns, strict=True))


def fixed_strings(signs: np.ndarray) -> pa.Array:
    """Strings of equal length from an array of their signs."""
    n = signs.shape[-1]
    count = signs.size // n
    return pa.StringArray.from_buffers(count, pa.py_buffer(np.arange(count + 1, dtype=np.int32) * np.int32(n)), pa.py_buffer(np.ascontiguousarray(signs).data))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each value begins and the last ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)), at


def fragment_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Reads of fragments that come with their ends: chrom, win, ploid, k, key, swap, start, off, size, cigar, left, right."""
    for whole in batches:
        for low in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(low, AT_ONCE)
            col = {c: b.column(c) for c in b.schema.names}
            num = {c: col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "off", "size", "key")}
            left, at_left = strings(col["left"])
            right, at_right = strings(col["right"])
            sides = [(at_left[:-1], np.diff(at_left), num["off"]), (at_right[:-1] + len(left), np.diff(at_right), num["off"] + num["size"] - np.diff(at_right))]
            made = made_reads(model, num["key"].view(np.uint64), col["swap"].to_numpy(zero_copy_only=False).astype(bool), num["start"], np.arange(b.num_rows), Alignments(col["cigar"].to_pylist()), np.concatenate((left, right)), sides[: 1 + model.paired])
            again = pa.array(np.repeat(np.arange(b.num_rows), 1 + model.paired))
            yield pa.RecordBatch.from_arrays([*(col[c].take(again) for c in ("chrom", "win", "ploid", "k")), *made.values()], names=["chrom", "win", "ploid", "k", *made])


def drawn(prefix: bytes, ks: range) -> list[int]:
    """For each k the first 32 bits of the md5 digest of prefix and k."""
    return [int.from_bytes(md5(b"%b%d" % (prefix, k), usedforsecurity=False).digest()[:4]) for k in ks]


def sampled_batches(batches: Iterator[pa.RecordBatch], model, gc_scalars: list[float] | None, tile: int) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Reads of fragments drawn from haplotypes: chrom, win, ploid, of (the three as one key), hash (of the seed and the three), start, seq, cigar.

    Starts are drawn tile by tile, each tile weighted by its GC content's coverage scalar.
    Draws are those of ``uniform`` with the keys ("read", seed, what, of, k).
    """
    scalars = np.array(gc_scalars if gc_scalars is not None else [1.0] * (tile + 1), np.float64)
    even = gc_scalars is None
    per_base = model.coverage / model.ploidy / (model.length * (2 if model.paired else 1))
    if model.paired:
        sizes, weights = model.lengths()
        from strandloom.functions.random import cumulative

        lows = np.array(cumulative(weights) if sum(weights) >= 1e-12 else [0.0] + [2.0] * (len(sizes) - 1))
        sizes = np.array(sizes, np.int64)
    reach = model.length + SPARE

    def finished(b: pa.RecordBatch, data: np.ndarray, at: np.ndarray, alignments: Alignments, parts: list[tuple]) -> pa.RecordBatch:
        row, k = np.concatenate([np.full(len(p[1]), p[0]) for p in parts]), np.concatenate([np.array(p[1], np.int32) for p in parts])
        tiles, off, size, strand = (np.concatenate([p[j] for p in parts]) for j in (2, 3, 4, 5))
        length = np.diff(at)[row]
        size = np.minimum(size, length)
        off = np.minimum(tiles * tile + np.floor(off * tile).astype(np.int64), length - size)
        key = xxhash_int(k, b.column("hash").to_numpy()[row])
        low = np.maximum(off + size - reach, 0)
        sides = [(at[:-1][row] + off, np.minimum(reach, length - off), off), (at[:-1][row] + low, off + size - low, low)]
        made = made_reads(model, key, strand < 0.5, b.column("start").to_numpy()[row].astype(np.int64), row, alignments, data, sides[: 1 + model.paired])
        again = np.repeat(np.arange(len(row)), 1 + model.paired)
        columns = [b.column(c).take(pa.array(row[again])) for c in ("chrom", "win", "ploid")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(k[again]), *made.values()], names=["chrom", "win", "ploid", "k", *made])

    for b in batches:
        if not b.num_rows:
            continue
        data, at = strings(b.column("seq"))
        strong = None if even else np.concatenate(([0], np.cumsum((data == ord("G")) | (data == ord("C")))))
        alignments, parts, held = Alignments(b.column("cigar").to_pylist()), [], 0
        for i, of in enumerate(b.column("of").to_pylist()):
            length = int(at[i + 1] - at[i])
            if length < model.span:
                continue
            n_tiles = max((length - model.span) // tile, 0)
            if even:
                most = float(n_tiles + 1)
            else:
                edges = at[i] + np.minimum(np.arange(n_tiles + 2) * tile, length)
                cum = np.concatenate(([0.0], np.cumsum(scalars[np.diff(strong[edges])])))
                most = float(cum[-1])
                if not most > 0:
                    continue
            every = range(1, int(length * per_base) + 2)
            for first in range(every.start, every.stop, AT_ONCE):
                ks = range(first, min(first + AT_ONCE, every.stop))
                draws = lambda what, kind="read", ks=ks, of=of: np.array(drawn(f"{kind}:{model.seed}:{what}{of}:".encode(), ks), np.float64) / 4294967296.0
                u = draws("tile:") * most
                tiles = u.astype(np.int64) if even else np.searchsorted(cum, u, "right") - 1
                size = sizes[np.searchsorted(lows, draws("size:"), "right") - 1] if model.paired else np.full(len(ks), model.length)
                parts.append((i, ks, tiles, draws("off:"), size, draws("", "strand")))
                held += len(ks)
                if held >= AT_ONCE:
                    yield finished(b, data, at, alignments, parts)
                    parts, held = [], 0
        if parts:
            yield finished(b, data, at, alignments, parts)
