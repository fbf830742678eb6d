"""Progressive JPEG in numpy: many small images at once, scan by scan.

Entropy-coded segments are cut by restart markers into short lanes. All lanes of one kind of
scan, of all images of a batch, advance together: each step reads one Huffman symbol in every
lane. Scans add to coefficient arrays: first passes bring the high bits of a spectral band,
refinements one more bit. Images are frames of one, or of three components of any sampling by
1 or 2, with 8-bit samples and restart intervals of any length.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Fixed by the format: the place in the 8 x 8 block of the n-th coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))

# Code lengths of the symbols that this encoder writes. Text bytes less 128 and halved have
# three to six bits; runs of zeros are rare.
DC_LENGTHS = {s: (3 if s in (0, 3, 4, 5) else 4 if s in (1, 2, 6) else 6) for s in range(9)}
AC_LENGTHS = {r << 4 | s: 10 for r in range(16) for s in range(1, 9)} | {r << 4: 10 for r in range(16)} | {s: 3 for s in (2, 3, 4, 5, 6)} | {1: 6, 7: 6, 8: 6, 0: 6, 0xF0: 6}
REFINE_LENGTHS = {0: 1} | {r << 4 | 1: 6 for r in range(16)} | {0xF0: 6} | {r << 4: 8 for r in range(1, 15)}

#: Blocks, or units of an interleaved scan, in a restart interval.
INTERVAL = 4
#: Payload bytes of one frame at most; longer payloads become several frames one after another.
FRAME_BYTES = 384 * 2048


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(code, length) by symbol and the table segment's body: shorter codes first."""
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    at, last = 0, lengths[order[0]]
    for s in order:
        at <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = at, last
        at += 1
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return code, size, counts + bytes(order)


_DC, _AC, _REFINE = _codes(DC_LENGTHS), _codes(AC_LENGTHS), _codes(REFINE_LENGTHS)


def geometry(n_blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, rows) of units of 4 luma and 2 chroma blocks, about square."""
    units = np.maximum(1, -(-n_blocks // 6))
    cols = np.ceil(np.sqrt(units)).astype(np.int64)
    return cols, -(-units // cols)


@lru_cache(maxsize=4096)
def _unit_order(cols: int, rows: int) -> np.ndarray:
    """Blocks in the order of an interleaved scan, as places in Y, Cb, Cr raster order."""
    r, c = np.divmod(np.arange(cols * rows), cols)
    w = 2 * cols
    y = np.stack([2 * r * w + 2 * c, 2 * r * w + 2 * c + 1, (2 * r + 1) * w + 2 * c, (2 * r + 1) * w + 2 * c + 1], 1)
    first = 4 * cols * rows
    return np.concatenate([y, np.stack([first + r * cols + c, first + cols * rows + r * cols + c], 1)], 1).ravel()


#: Size and extra bits of each signed value from -256 to 255.
_VALUES = np.arange(-256, 256)
_SIZE = np.array([abs(v).bit_length() for v in range(-256, 256)])
_EXTRA = np.where(_VALUES < 0, _VALUES + (1 << _SIZE) - 1, _VALUES)


def _bits_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, extra bits) of signed values."""
    return _SIZE[v + 256], _EXTRA[v + 256]


def _packed(value: np.ndarray, n_bits: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of up to 17 bits into bytes; each lane starts at a byte and is filled up with
    ones. Returns (bytes, end of each lane)."""
    bits = np.bincount(lane, n_bits, lanes).astype(np.int64)
    n_bytes = -(-bits // 8)
    ends = np.cumsum(n_bytes)
    start = ends - n_bytes
    at = np.cumsum(n_bits) - n_bits + (start * 8 - (np.cumsum(bits) - bits))[lane]
    word, byte = value << (24 - n_bits - (at & 7)), at >> 3
    out = np.zeros(int(ends[-1]) + 3 if lanes else 3)
    for j in range(3):
        out += np.bincount(byte + j, (word >> (16 - 8 * j)) & 255, len(out))
    out = out[:-3].astype(np.uint8)
    used = n_bytes > 0
    out[ends[used] - 1] += ((1 << (n_bytes * 8 - bits)) - 1)[used].astype(np.uint8)
    return out, ends


def _segments(raw: np.ndarray, ends: np.ndarray, nth: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Stuffs a zero behind each 0xFF and puts restart markers between the lanes of one scan.
    nth: a lane's number in its scan; last: whether it is the scan's last."""
    stuffed = np.flatnonzero(raw == 255) + 1
    marks = ends[~last]
    where = np.concatenate([stuffed, np.repeat(marks, 2)])
    what = np.concatenate([np.zeros(len(stuffed)), np.stack([np.full(len(marks), 255), 0xD0 + nth[~last] % 8], 1).ravel()])
    out = np.insert(raw, where, what.astype(np.uint8))
    added = np.searchsorted(stuffed, ends, "right") + 2 * np.cumsum(~last)
    return out.tobytes(), ends + added


#: Code and extra bits together of a value that follows no zeros.
_FIRST_TOKEN, _FIRST_BITS = _AC[0][_SIZE] << _SIZE | _EXTRA, _AC[1][_SIZE] + _SIZE


def _first_pass(coef: np.ndarray, low: int, high: int, block_lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (value, bits, lane) of a band's first pass, the lowest bit left out."""
    v = coef[:, low : high + 1]
    v = np.sign(v) * (np.abs(v) >> 1)
    at = np.flatnonzero(v)
    width = high - low + 1
    block, k = at // width, at % width
    run = np.diff(at, prepend=-1) - 1
    run = np.where(run > k, k, run)
    value = v.ravel()[at] + 256
    code, length, _ = _AC
    token, n_bits = _FIRST_TOKEN[value], _FIRST_BITS[value]
    late = np.flatnonzero(run)
    size = _SIZE[value[late]]
    symbol = (run[late] % 16) << 4 | size
    token[late], n_bits[late] = code[symbol] << size | _EXTRA[value[late]], length[symbol] + size
    count = np.bincount(block, minlength=len(v))
    through = np.cumsum(count)
    ends_early = np.ones(len(v), bool)
    ends_early[block[k == high - low]] = False
    ended = np.flatnonzero(ends_early)
    zeros = np.repeat(np.arange(len(run)), run // 16)
    where = np.concatenate([through[ended], zeros])
    fill = lambda base, eob, zrl: np.insert(base, where, np.concatenate([np.broadcast_to(eob, len(ended)), np.broadcast_to(zrl, len(zeros))]))
    lane = np.insert(block_lane[block], where, np.concatenate([block_lane[ended], block_lane[block[zeros]]]))
    return fill(token, code[0], code[0xF0]), fill(n_bits, length[0], length[0xF0]), lane


def _refined(coef: np.ndarray, block_lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the refinement of all AC coefficients by their lowest bit.

    A group is what lies up to a coefficient that becomes non-zero now, cut after each 16 zeros;
    its symbol comes first, then the low bits of those that are non-zero already. What is behind
    the last such coefficient is one group more, under an end-of-block symbol."""
    v = coef[:, 1:].astype(np.int64)
    a = np.abs(v)
    n, width = v.shape
    new, zero, old = a == 1, a == 0, a > 1
    group = np.cumsum(new, 1) - new
    total = new.sum(1)
    zeros_before = np.cumsum(zero, 1) - zero
    at_new = np.zeros((n, width + 1), np.int64)
    b, k = np.nonzero(new)
    at_new[b, group[b, k] + 1] = zeros_before[b, k]
    inside = zeros_before - np.take_along_axis(at_new, group, 1)
    sub = np.where(group == total[:, None], 0, inside // 16)
    key = (np.arange(n)[:, None] * 64 + group) * 4 + sub
    hb, hk = np.nonzero(old)
    bit_key, bit = key[hb, hk], a[hb, hk] & 1
    code, length, _ = _REFINE
    # Symbols: one for each new coefficient, its runs of 16 zeros before it, and ends of blocks.
    run = inside[b, k]
    symbol = (run % 16) << 4 | 1
    new_key, new_token, new_bits = key[b, k], code[symbol] << 1 | (v[b, k] > 0), length[symbol] + 1
    reps = run // 16
    z = np.repeat(np.arange(len(b)), reps)
    z_key = (new_key - reps)[z] + (np.arange(len(z)) - np.repeat(np.cumsum(reps) - reps, reps))
    tail = np.flatnonzero(~new[:, -1])
    tail_key = (tail * 64 + total[tail]) * 4
    s_key = np.concatenate([new_key, z_key, tail_key])
    s_token = np.concatenate([new_token, np.full(len(z), code[0xF0]), np.full(len(tail), code[0])])
    s_bits = np.concatenate([new_bits, np.full(len(z), length[0xF0]), np.full(len(tail), length[0])])
    order = np.argsort(s_key, kind="stable")
    where = np.searchsorted(bit_key, s_key[order])
    lane = np.insert(block_lane[hb], where, block_lane[s_key[order] // 256])
    return np.insert(bit, where, s_token[order]), np.insert(np.ones(len(bit), np.int64), where, s_bits[order]), lane


def encode(payloads: list[bytes]) -> list[bytes]:
    """One frame for each payload of a positive multiple of 64 bytes, each 64 bytes the
    coefficients of a block in zigzag order, less 128."""
    n_blocks = np.array([len(p) // 64 for p in payloads])
    cols, rows = geometry(n_blocks)
    units = cols * rows
    blocks = 6 * units
    first = np.cumsum(blocks) - blocks
    coef = np.zeros((int(blocks.sum()), 64), np.int16)
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64).astype(np.int16) - 128
    coef[np.arange(len(raw)) + np.repeat(first - (np.cumsum(n_blocks) - n_blocks), n_blocks)] = raw
    parts: list[list[bytes]] = [[] for _ in payloads]

    def put(tokens, scan_lanes: np.ndarray, header: list[bytes]) -> None:
        """scan_lanes: lanes of each scan, the scans image by image."""
        lanes = int(scan_lanes.sum())
        nth = np.arange(lanes) - np.repeat(np.cumsum(scan_lanes) - scan_lanes, scan_lanes)
        last = nth == np.repeat(scan_lanes, scan_lanes) - 1
        out, ends = _segments(*_packed(*tokens, lanes), nth, last)
        ends, start, per = ends[last].tolist(), 0, len(header)
        for i, end in enumerate(ends):
            parts[i // per] += [header[i % per], out[start:end]]
            start = end

    # Coefficient 0: all components interleaved, high bits first.
    order = np.concatenate([_unit_order(c, r) + f for c, r, f in zip(cols.tolist(), rows.tolist(), first.tolist())])
    kind = np.tile([0, 0, 0, 0, 1, 2], int(units.sum()))
    unit = np.arange(len(order)) // 6
    in_image = unit - np.repeat(np.cumsum(units) - units, blocks)
    dc_lanes = -(-units // INTERVAL)
    lane = np.repeat(np.cumsum(dc_lanes) - dc_lanes, blocks) + in_image // INTERVAL
    dc = coef[order, 0].astype(np.int64)
    diff = dc >> 1
    for c in range(3):
        mine = np.flatnonzero(kind == c)
        value = dc[mine] >> 1
        fresh = np.concatenate([[True], lane[mine][1:] != lane[mine][:-1]])
        diff[mine] = value - np.where(fresh, 0, np.concatenate([[0], value[:-1]]))
    size, extra = _bits_of(diff)
    put((_DC[0][size] << size | extra, _DC[1][size] + size, lane), dc_lanes, [_scan((1, 2, 3), 0, 0, 0, 1)])

    # All others: by component, in two bands and then refined.
    comp_blocks = np.stack([4 * units, units, units], 1).ravel()
    comp_lanes = -(-comp_blocks // INTERVAL)
    in_comp = np.arange(len(coef)) - np.repeat(np.cumsum(comp_blocks) - comp_blocks, comp_blocks)
    lane = np.repeat(np.cumsum(comp_lanes) - comp_lanes, comp_blocks) + in_comp // INTERVAL
    for low, high in ((1, 5), (6, 63)):
        put(_first_pass(coef, low, high, lane), comp_lanes, [_scan((c,), low, high, 0, 1) for c in (1, 2, 3)])
    dc_lane = np.repeat(np.cumsum(dc_lanes) - dc_lanes, blocks) + in_image // INTERVAL
    put((dc & 1, np.ones(len(dc), np.int64), dc_lane), dc_lanes, [_scan((1, 2, 3), 0, 0, 1, 0)])
    put(_refined(coef, lane), comp_lanes, [_scan((c,), 1, 63, 1, 0) for c in (1, 2, 3)])
    return [_head(int(c), int(r), len(p)) + b"".join(x) + b"\xff\xd9" for c, r, p, x in zip(cols, rows, payloads, parts)]


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


_TABLES = _marker(0xDB, b"\x00" + b"\x01" * 64) + _marker(0xC4, b"\x00" + _DC[2]) + _marker(0xC4, b"\x10" + _AC[2]) + _marker(0xC4, b"\x11" + _REFINE[2]) + _marker(0xDD, struct.pack(">H", INTERVAL))


def _head(cols: int, rows: int, n_bytes: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    return b"\xff\xd8" + _marker(0xFE, struct.pack(">I", n_bytes)) + _TABLES + _marker(0xC2, frame)


def _scan(components: tuple[int, ...], low: int, high: int, ah: int, al: int) -> bytes:
    table = 1 if ah else 0
    return _marker(0xDA, bytes((len(components), *(x for c in components for x in (c, table)), low, high, ah << 4 | al)))


@dataclass
class Frame:
    """One image: its components' sampling, tables, and where its coefficients begin."""

    n_bytes: int = -1
    width: int = 0
    height: int = 0
    sampling: list[tuple[int, int, int]] = field(default_factory=list)  # id, across, down
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    quant_of: list[int] = field(default_factory=list)
    first: int = 0
    scans: list = field(default_factory=list)

    def planes(self) -> list[tuple[int, int, int]]:
        """(first block, blocks across, down) by component, padding included."""
        return [(self.first + at, w, h) for at, w, h, *_ in _layout(self.width, self.height, tuple(self.sampling))]


@lru_cache(maxsize=4096)
def _layout(width: int, height: int, sampling: tuple) -> tuple[tuple[int, int, int, int, int], ...]:
    """(first block, blocks across, down, and the same without padding) by component."""
    across, down = max(s[1] for s in sampling), max(s[2] for s in sampling)
    cols, rows = -(-width // (8 * across)), -(-height // (8 * down))
    out, at = [], 0
    for _, h, v in sampling:
        out.append((at, cols * h, rows * v, -(-(-(-width * h // across)) // 8), -(-(-(-height * v // down)) // 8)))
        at += cols * h * rows * v
    return tuple(out)


@lru_cache(maxsize=4096)
def _order(width: int, height: int, sampling: tuple, ids: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(block, component's place in the scan) of each block of a scan, and blocks a unit."""
    planes = _layout(width, height, sampling)
    where = [next(i for i, s in enumerate(sampling) if s[0] == c) for c in ids]
    if len(ids) == 1:
        at, w, _, real_w, real_h = planes[where[0]]
        block = at + (np.arange(real_h)[:, None] * w + np.arange(real_w)).ravel()
        return block, np.zeros(len(block), np.int64), 1
    _, h, v = sampling[0]
    cols, rows = planes[0][1] // h, planes[0][2] // v
    r, c = np.divmod(np.arange(cols * rows), cols)
    blocks, comps = [], []
    for place, i in enumerate(where):
        at, w, *_ = planes[i]
        _, h, v = sampling[i]
        for y in range(v):
            for x in range(h):
                blocks.append(at + (r * v + y) * w + c * h + x)
                comps.append(np.full(len(r), place))
    return np.stack(blocks, 1).ravel(), np.stack(comps, 1).ravel(), len(blocks)


@lru_cache(maxsize=64)
def _lookup(body: bytes) -> np.ndarray:
    """For each next 16 bits: symbol << 8 | length of its code."""
    out, at, symbols = np.zeros(1 << 16, np.int32), 0, iter(body[16:])
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            span = 1 << (16 - n)
            out[at : at + span] = next(symbols) << 8 | n
            at += span
    return out


def _parsed(raw: bytes, markers: np.ndarray) -> list[Frame]:
    """Reads all frames' segments. markers: places of 0xFF before anything but a stuffed zero
    or a restart, where scans' data can end."""
    frames, at, frame, interval, tables = [], 0, None, 0, {}
    while at + 1 < len(raw):
        if raw[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        kind = raw[at + 1]
        if kind == 0xD8:
            frame, interval, tables = Frame(), 0, {}
        elif kind == 0xD9:
            frames.append(frame)
        if kind in (0xD8, 0xD9):
            at += 2
            continue
        (size,) = struct.unpack_from(">H", raw, at + 2)
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE and len(body) == 4:
            (frame.n_bytes,) = struct.unpack(">I", body)
        elif kind == 0xDB:
            while body:
                frame.quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.float64)
                body = body[65:]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif kind == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif kind == 0xC2:
            _, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
            frame.sampling = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)]
            frame.quant_of = [body[8 + 3 * i] for i in range(n)]
        elif kind == 0xDA:
            n = body[0]
            ids = tuple(body[1 + 2 * i] for i in range(n))
            low, high, steps = body[1 + 2 * n : 4 + 2 * n]
            used = body[2] >> 4 if low == 0 else 0x10 | (body[2] & 15)
            end = int(markers[np.searchsorted(markers, at)])
            frame.scans.append((ids, low, high, steps >> 4, steps & 15, tables.get(used, b""), interval, at, end))
            at = end
    return frames


def decode(files: list[bytes]) -> tuple[np.ndarray, list[list[Frame]]]:
    """(coefficients of all blocks in zigzag order, each file's frames)."""
    whole = b"".join(files)
    buf = np.frombuffer(whole, np.uint8)
    ff = np.flatnonzero(buf[:-1] == 255)
    after = buf[ff + 1]
    restart = (after >= 0xD0) & (after <= 0xD7)
    markers = ff[(after != 0) & ~restart & (after != 255)]
    frames, out, offset = [], [], 0
    for f in files:
        a, b = np.searchsorted(markers, (offset, offset + len(f)))
        own = _parsed(f, markers[a:b] - offset)
        for frame in own:
            frame.scans = [(*s[:7], s[7] + offset, s[8] + offset) for s in frame.scans]
        out.append(own)
        frames += own
        offset += len(f)
    total = 0
    for frame in frames:
        frame.first = total
        at, w, h, *_ = _layout(frame.width, frame.height, tuple(frame.sampling))[-1]
        total += at + w * h
    coef = np.zeros((total, 64), np.int16)

    spans = sorted((s[7], s[8]) for f in frames for s in f.scans)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[[a for a, _ in spans]] += 1
    inside[[b for _, b in spans]] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool)
    keep = inside.copy()
    hits = ff[inside[ff]]
    follow = buf[hits + 1]
    keep[hits[follow == 0] + 1] = False
    marks = hits[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    new_at = np.cumsum(keep) - keep
    data = np.concatenate([buf[keep], np.full(8, 255, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(data) - 7, np.uint64)
    for j in range(8):
        window |= data[j : len(data) - 7 + j] << np.uint64(56 - 8 * j)

    stages: dict[tuple, list] = {}
    for frame in frames:
        for nth, s in enumerate(frame.scans):
            # Scans of one kind and turn run together; turns keep their order.
            stages.setdefault((nth if len(s[0]) > 1 or s[1] == 0 else _turn(frame, nth), s[1:6]), []).append((frame, s))
    for (_, (low, high, ah, al, table)), scans in sorted(stages.items(), key=lambda x: x[0][0]):
        orders = [_order(f.width, f.height, tuple(f.sampling), scan[0]) for f, scan in scans]
        n = np.array([len(o[0]) for o in orders])
        base = np.cumsum(n) - n
        order = np.stack([np.concatenate([o[0] for o in orders]) + np.repeat([f.first for f, _ in scans], n), np.concatenate([o[1] for o in orders])], 1)
        step = np.array([scan[6] * o[2] if scan[6] else len(o[0]) for (_, scan), o in zip(scans, orders)])
        begin, stop = (np.array([scan[x] for _, scan in scans]) for x in (7, 8))
        i, j = np.searchsorted(marks, begin), np.searchsorted(marks, stop)
        count = j - i + 1
        rep = lambda x: np.repeat(x, count)
        nth = np.arange(count.sum()) - rep(np.cumsum(count) - count)
        starts = np.where(nth == 0, rep(begin), np.append(marks, 0)[rep(i) + nth - 1] + 2)
        cut = np.minimum(nth * rep(step), rep(n))
        lanes = (new_at[np.minimum(starts, len(new_at) - 1)], rep(base) + cut, rep(base) + np.minimum(cut + rep(step), rep(n)))
        if low == 0:
            (_dc_refine if ah else _dc_first)(coef, order, lanes, window, al, table)
        else:
            (_ac_refine if ah else _ac_first)(coef, order[:, 0], lanes, window, low, high, al, table)
    return coef, out


def _turn(frame: Frame, nth: int) -> int:
    """A scan's turn: components' scans of one band may go together, at the first one's turn."""
    s = frame.scans[nth]
    while nth and len(frame.scans[nth - 1][0]) == 1 and frame.scans[nth - 1][1:6] == s[1:6] and frame.scans[nth - 1][0] != s[0]:
        nth -= 1
    return nth


def _peek(window: np.ndarray, at: np.ndarray) -> np.ndarray:
    return window[np.minimum(at >> 3, len(window) - 1)] << (at & 7).astype(np.uint64)


def _take(x: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n bits behind the first ``skip`` of each window; 0 where n is 0."""
    y = (x << skip.astype(np.uint64)) >> np.uint64(1)
    return (y >> (63 - n).astype(np.uint64)).astype(np.int64)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits) * (size > 0)


def _dc_first(coef, order, lanes, window, al, table) -> None:
    look = _lookup(table)
    start, i, end = lanes
    at, i = start * 8, i.copy()
    before = np.zeros((len(i), 4), np.int64)
    live = np.flatnonzero(i < end)
    while len(live):
        x = _peek(window, at[live])
        found = look[(x >> np.uint64(48)).astype(np.int64)]
        size, length = found >> 8, found & 255
        block, comp = order[i[live]].T
        before[live, comp] += _signed(_take(x, length, size), size)
        coef[block, 0] = before[live, comp] << al
        at[live] += length + size
        i[live] += 1
        live = live[i[live] < end[live]]


def _dc_refine(coef, order, lanes, window, al, table) -> None:
    start, first, end = lanes
    n = end - first
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(start * 8, n) + nth
    bit = (_peek(window, at) >> np.uint64(63)).astype(np.int16)
    coef[order[np.repeat(first, n) + nth, 0], 0] |= bit << al


def _ac_first(coef, order, lanes, window, low, high, al, table) -> None:
    look = _lookup(table)
    start, i, end = lanes
    keep = np.flatnonzero(i < end)
    at, i, end = start[keep] * 8, i[keep].copy(), end[keep]
    k, skip = np.full(len(i), low), np.zeros(len(i), np.int64)
    while len(i):
        x = _peek(window, at)
        found = look[(x >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        symbol, length = found >> 8, found & 255
        run, size = symbol >> 4, symbol & 15
        value = size > 0
        more = np.where(value, size, np.where(run < 15, run, 0))
        bits = _take(x, length, more)
        at += length + more
        k += np.where(value | (run == 15), run, 0)
        v = np.flatnonzero(value)
        coef[order[i[v]], np.minimum(k[v], 63)] = _signed(bits[v], size[v]) << al
        k += value | (run == 15)
        done = ~value & (run < 15)
        skip[done] = (1 << run[done]) + bits[done]  # this block and more
        over = (k > high) & ~done
        if done.any() or over.any():
            i += np.where(done, skip, over)
            k[done | over] = low
            stay = i < end
            if not stay.all():
                at, i, end, k, skip = at[stay], i[stay], end[stay], k[stay], skip[stay]


def _ac_refine(coef, order, lanes, window, low, high, al, table) -> None:
    look = _lookup(table)
    start, i, end = lanes
    keep = np.flatnonzero(i < end)
    at, i, end = start[keep] * 8, i[keep].copy(), end[keep]
    k, run_on = np.full(len(i), low), np.zeros(len(i), np.int64)
    place = np.arange(64)
    while len(i):
        x = _peek(window, at)
        found = look[(x >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        reads = run_on == 0
        symbol, length = np.where(reads, found >> 8, 0), np.where(reads, found & 255, 0)
        run, size = symbol >> 4, symbol & 15
        ends = reads & (size == 0) & (run < 15)
        more = np.where(size > 0, 1, np.where(ends, run, 0))
        bits = _take(x, length, more)
        at += length + more
        run_on[ends] = (1 << run[ends]) + bits[ends]
        block = order[i]
        rows = coef[block]
        beyond = (place >= k[:, None]) & (place <= high)
        zero = (rows == 0) & beyond
        count = np.cumsum(zero, 1)
        stop = np.where(run_on > 0, high + 1, np.where(count[:, -1] > run, (count == run[:, None] + 1).argmax(1), high + 1))
        old = (rows != 0) & beyond & (place < stop[:, None])
        r, c = np.nonzero(old)
        n_old = old.sum(1)
        nth = np.arange(len(r)) - np.repeat(np.cumsum(n_old) - n_old, n_old)
        bit = (_peek(window, at[r] + nth) >> np.uint64(63)).astype(np.int16)
        rows[r, c] += np.sign(rows[r, c]) * (bit << al)
        at += n_old
        new = np.flatnonzero((size > 0) & (stop <= high))
        rows[new, stop[new]] = np.where(bits[new] > 0, 1, -1) << al
        coef[block] = rows
        k = stop + 1
        through = (run_on > 0) | (k > high)
        run_on -= run_on > 0
        i += through
        k[through] = low
        stay = i < end
        if not stay.all():
            at, i, end, k, run_on = at[stay], i[stay], end[stay], k[stay], run_on[stay]


def _inverse() -> np.ndarray:
    """The inverse transform of a block in zigzag order as one 64 x 64 matrix of whole numbers
    over 2**14: products and sums are exact, whatever their order."""
    n = np.arange(8)
    c = np.cos((2 * n[:, None] + 1) * n * np.pi / 16) / 2
    c[:, 0] /= np.sqrt(2)
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << 14))


_INVERSE = _inverse()


def rgb(coef: np.ndarray, frame: Frame) -> np.ndarray:
    """The frame's full-resolution RGB tensor, height x width x 3."""
    planes = []
    for (first, w, h), (_, across, down), q in zip(frame.planes(), frame.sampling, frame.quant_of):
        x = coef[first : first + w * h].astype(np.float64) * frame.quant[q]
        s = np.clip(np.floor((x @ _INVERSE + (1 << 13)) / (1 << 14)) + 128, 0, 255).astype(np.int32)
        plane = s.reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 8 * w)
        top_across, top_down = max(s[1] for s in frame.sampling), max(s[2] for s in frame.sampling)
        plane = plane.repeat(top_down // down, 0).repeat(top_across // across, 1)
        planes.append(plane[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    half = 1 << 15  # fixed: the format's colour weights, over 2**16
    out = np.stack([y + ((91881 * cr + half) >> 16), y - ((22554 * cb + 46802 * cr + half) >> 16), y + ((116130 * cb + half) >> 16)], 2)
    return np.clip(out, 0, 255).astype(np.uint8)
