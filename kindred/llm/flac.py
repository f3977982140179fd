"""FLAC in numpy: an encoder for 8-bit mono blocks and a decoder for whole streams.

The decoder has two ways. `decode_many` reads all one-channel, one-partition frames of many streams
in step: one array operation reads the i-th residual of every frame. Streams it does not fit go
through `decode_stream`, which reads any FLAC subframe bit by bit. Both verify the header's CRC-8,
the frame's CRC-16 and the MD5 of the samples, and raise ValueError where one is wrong.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

BLOCK = 192  # samples in an encoded frame; the format has a code for this size
RATE = 8000
CHUNK_FRAMES = 4096
LONGEST_RUN = 40  # zeros before a Rice stop bit that decode_many can read in step

# Fixed values of the format: polynomial predictors, block sizes, sample rates and sizes by code.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
SIZES = {1: 192} | {c: 576 << (c - 2) for c in range(2, 6)} | {c: 256 << (c - 8) for c in range(8, 16)}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        crc = byte << (width - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, dtype=np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_LADDERS: dict[int, np.ndarray] = {}


def _ladder(width: int, length: int) -> np.ndarray:
    """Row d: what a byte adds to the CRC when d bytes follow it (a CRC from 0 is linear)."""
    have = _LADDERS.get(width)
    if have is None or len(have) < length:
        table = _CRC8 if width == 8 else _CRC16
        rows = [table]
        for _ in range(max(length, 256) - 1):
            last = rows[-1]
            rows.append(((last << 8) & ((1 << width) - 1)) ^ table[last >> (width - 8)])
        have = _LADDERS[width] = np.array(rows)
    return have


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """CRC of each range of data (no range empty)."""
    ladder = _ladder(width, int(lengths.max())).ravel()
    ends = np.cumsum(lengths)
    first = ends - lengths
    place = np.arange(ends[-1])
    row = np.repeat(ends - 1, lengths)
    row -= place
    row <<= 8
    place += np.repeat(starts - first, lengths)
    row += data[place]
    return np.bitwise_xor.reduceat(ladder[row], first)


def crc_bytes(data: bytes, width: int) -> int:
    table, crc = (_CRC8, 0) if width == 8 else (_CRC16, 0)
    mask = (1 << width) - 1
    for byte in data:
        crc = ((crc << 8) & mask) ^ int(table[(crc >> (width - 8)) ^ byte])
    return crc


def _number_bytes(n: int) -> int:
    """Bytes of the UTF-8-like code of a frame number."""
    return 1 if n < 1 << 7 else next(k for k in range(2, 8) if n < 1 << (5 * k + 1))


def _coded_number(n: int) -> bytes:
    k = _number_bytes(n)
    if k == 1:
        return bytes([n])
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(k - 1)][::-1]
    return bytes([((0xFF << (8 - k)) & 0xFF) | (n >> (6 * (k - 1))), *tail])


def _packed_fields(fields: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Bytes that hold fields (bit after the last one, value below 2**32); fields do not overlap.

    A field touches two 32-bit words at most, and as no bit is set twice, sums are the same as ors.
    """
    words = np.zeros(size // 4 + 3)
    for end, value in fields:
        last = end - 1
        word = last >> 5
        wide = value.astype(np.int64) << (31 - (last & 31))
        words += np.bincount(word + 1, weights=wide & 0xFFFFFFFF, minlength=len(words))
        words += np.bincount(word, weights=wide >> 32, minlength=len(words))
    return words[1:].astype(np.uint32).astype(">u4").view(np.uint8)[:size].copy()


def _encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of 8-bit mono samples (frames x BLOCK); their bytes and lengths."""
    x = samples.astype(np.int32)
    n = len(x)
    d1 = x[:, 1:] - x[:, :-1]
    d2 = d1[:, 1:] - d1[:, :-1]
    # A two-tap predictor from each frame's autocorrelation, in 1/64.
    f = x.astype(np.float32)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = np.where((d := r0 * r0 - r1 * r1) > 0, d, 1)
    taps = np.stack([r1 * (r0 - r2) / det, (r0 * r2 - r1 * r1) / det], 1)
    taps = np.clip(np.rint(taps * 64), -127, 127).astype(np.int32)
    lp = x[:, 2:] - ((taps[:, :1] * x[:, 1:-1] + taps[:, 1:] * x[:, :-2]) >> 6)
    zig = [(r << 1) ^ (r >> 31) for r in (x, d1, d2, lp)]
    cost = np.stack([z[:, -(BLOCK - 2) :].sum(1) for z in zig], 1)
    kind = cost.argmin(1)
    flat = (d1 == 0).all(1)
    order = np.array([0, 1, 2, 2])[kind]
    u = zig[0].copy()
    for k in (1, 2, 3):
        m = kind == k
        u[m, BLOCK - zig[k].shape[1] :] = zig[k][m]
    coded = np.arange(BLOCK) >= order[:, None]
    u[~coded] = 0
    mean = u.sum(1) / (BLOCK - order)
    guess = np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64)
    tries = np.stack([np.clip(guess + s, 0, 14) for s in (-1, 0, 1)], 1)
    spent = np.stack([(u >> tries[:, i : i + 1]).sum(1) + (BLOCK - order) * (tries[:, i] + 1) for i in range(3)], 1)
    rice = tries[np.arange(n), spent.argmin(1)]
    least = np.ceil(np.log2((u.max(1) + 1) / LONGEST_RUN)).astype(np.int64)
    rice = np.maximum(rice, least)

    sizes = np.array([_number_bytes(int(m)) for m in (numbers.min(), numbers.max())])
    head = np.full(n, sizes[0]) if sizes[0] == sizes[1] else np.array([_number_bytes(int(m)) for m in numbers])
    head_bits = (4 + head + 1) * 8
    params = 8 + 8 * order + np.where(kind == 3, 4 + 5 + 16, 0) + 10
    length = np.where(coded, (u >> rice[:, None]) + 1 + rice[:, None], 0)
    body = np.where(flat, 16, params + length.sum(1))
    frame_bytes = (head_bits + body + 7) // 8 + 2
    starts = np.cumsum(frame_bytes) - frame_bytes
    at = starts * 8
    fields = [(at + 32, np.full(n, 0xFFF81402))]
    coded_numbers = [_coded_number(int(m)) for m in numbers]
    for b in range(int(head.max())):
        has = head > b
        fields.append((at[has] + 40 + 8 * b, np.array([c[b] for c in coded_numbers if len(c) > b])))
    sub = at + head_bits
    fields.append((sub + 8, np.where(flat, 0, np.where(kind == 3, 0b100001, 8 + order)) << 1))
    fields.append((sub[flat] + 16, x[flat, 0] & 0xFF))
    live = ~flat
    for i in range(2):
        m = live & (order > i)
        fields.append((sub[m] + 16 + 8 * i, x[m, i] & 0xFF))
    m = live & (kind == 3)
    p = sub + 8 + 8 * order
    fields.append((p[m] + 9, np.full(m.sum(), (7 << 5) | 6)))
    for i in range(2):
        fields.append((p[m] + 17 + 8 * i, taps[m, i] & 0xFF))
    p = p + np.where(kind == 3, 25, 0)
    fields.append((p[live] + 10, rice[live]))
    code_end = (p + 10)[:, None] + np.cumsum(length, 1)
    value = (u & ((1 << rice) - 1)[:, None]) | (1 << rice)[:, None]
    keep = coded & live[:, None]
    fields.append((code_end[keep], value[keep]))
    data = _packed_fields(fields, int(frame_bytes.sum()))
    head_len = 4 + head
    data[starts + head_len] = crcs(data, starts, head_len, 8)
    body_len = frame_bytes - 2
    crc = crcs(data, starts, body_len, 16)
    data[starts + body_len] = crc >> 8
    data[starts + body_len + 1] = crc & 0xFF
    return data.tobytes(), frame_bytes


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each payload; a payload's bytes are unsigned 8-bit samples, a multiple of BLOCK."""
    counts = np.array([len(p) // BLOCK for p in payloads], dtype=np.int64)
    samples = (np.frombuffer(b"".join(payloads), dtype=np.uint8).astype(np.int16) - 128).astype(np.int8).reshape(-1, BLOCK)
    numbers = np.arange(len(samples)) - np.repeat(np.cumsum(counts) - counts, counts)
    pieces, lengths = [], []
    for a in range(0, len(samples), CHUNK_FRAMES):
        data, size = _encode_frames(samples[a : a + CHUNK_FRAMES], numbers[a : a + CHUNK_FRAMES])
        pieces.append(data)
        lengths.append(size)
    data, lengths = b"".join(pieces), np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out, frame = [], 0
    for count in counts.tolist():
        total = count * BLOCK
        md5 = hashlib.md5(samples[frame : frame + count].tobytes()).digest()
        own = lengths[frame : frame + count]
        info = (BLOCK << 64 + 64) | (BLOCK << 112) | (int(own.min()) << 88) | (int(own.max()) << 64)
        info |= (RATE << 44) | (0 << 41) | (7 << 36) | total
        out.append(b"fLaC" + b"\x80\x00\x00\x22" + info.to_bytes(18, "big") + md5 + data[ends[frame] : ends[frame + count]])
        frame += count
    return out


@dataclass
class Info:
    min_block: int
    max_block: int
    rate: int
    channels: int
    depth: int
    total: int
    md5: bytes
    first_frame: int


def read_info(media: bytes) -> Info:
    """STREAMINFO and the place of the first frame; other metadata blocks are stepped over."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info = 4, None
    while True:
        if at + 4 > len(media):
            raise ValueError("metadata runs past the end")
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        if kind & 0x7F == 0:
            b = media[at + 4 : at + 4 + size]
            mid = int.from_bytes(b[10:18], "big")
            info = (int.from_bytes(b[0:2], "big"), int.from_bytes(b[2:4], "big"), mid >> 44, ((mid >> 41) & 7) + 1, ((mid >> 36) & 31) + 1, mid & ((1 << 36) - 1), b[18:34])
        at += 4 + size
        if kind & 0x80:
            break
    if info is None:
        raise ValueError("no STREAMINFO")
    return Info(*info, at)


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("frame runs past the end")
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _residual(bits: _Bits, block: int, order: int) -> list[int]:
    method = bits.take(2)
    if method > 1:
        raise ValueError("reserved residual coding")
    width, parts = 4 + method, bits.take(4)
    out = []
    for part in range(1 << parts):
        count = (block >> parts) - (order if part == 0 else 0)
        k = bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(count)]
            continue
        for _ in range(count):
            v = (bits.unary() << k) | bits.take(k)
            out.append((v >> 1) ^ -(v & 1))
    return out


def _subframe(bits: _Bits, block: int, depth: int) -> list[int]:
    if bits.take(1):
        raise ValueError("bad subframe")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * block
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out, shift = [bits.signed(depth) for _ in range(order)], 0
        taps = FIXED.get(order) if kind < 32 else None
        if taps is None:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            taps = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, block, order):
            out.append(r + (sum(t * out[-1 - j] for j, t in enumerate(taps)) >> shift))
    else:
        raise ValueError("reserved subframe")
    return [v << wasted for v in out] if wasted else out


def decode_stream(media: bytes) -> tuple[Info, list[tuple[int, list[list[int]]]]]:
    """Any stream: its info and, by frame, the first sample's place and each channel's samples."""
    info = read_info(media)
    at, place, frames = info.first_frame, 0, []
    while at < len(media):
        bits = _Bits(media, at)
        if bits.take(15) != 0x7FFC:
            raise ValueError(f"no frame at byte {at}")
        bits.take(1)
        size_code, rate_code, layout, depth_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        lead = bits.take(8)
        more = 0 if lead < 0x80 else next(k for k in range(8) if not (lead >> (7 - k)) & 1) - 1
        bits.take(8 * more)
        block = bits.take(8) + 1 if size_code == 6 else bits.take(16) + 1 if size_code == 7 else SIZES.get(size_code)
        if block is None:
            raise ValueError("reserved block size")
        bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        end = bits.at >> 3
        if bits.take(8) != crc_bytes(media[at:end], 8):
            raise ValueError(f"header checksum at byte {at}")
        depth = DEPTHS.get(depth_code, info.depth)
        if layout > 10:
            raise ValueError("reserved channels")
        sides = {8: 1, 9: 0, 10: 1}.get(layout)
        count = layout + 1 if layout < 8 else 2
        ch = [_subframe(bits, block, depth + (c == sides)) for c in range(count)]
        if layout == 8:
            ch[1] = [a - b for a, b in zip(*ch, strict=True)]
        elif layout == 9:
            ch[0] = [a + b for a, b in zip(*ch, strict=True)]
        elif layout == 10:
            mid = [(m << 1) | (s & 1) for m, s in zip(*ch, strict=True)]
            ch = [[(m + s) >> 1 for m, s in zip(mid, ch[1], strict=True)], [(m - s) >> 1 for m, s in zip(mid, ch[1], strict=True)]]
        bits.at = (bits.at + 7) & ~7
        end = bits.at >> 3
        if bits.take(16) != crc_bytes(media[at:end], 16):
            raise ValueError(f"frame checksum at byte {at}")
        frames.append((place, ch))
        place += block
        at = end + 2
    if info.total and place != info.total:
        raise ValueError("samples are missing")
    return info, frames


def _pcm(info: Info, frames: list) -> bytes:
    """Interleaved little-endian samples; 8-bit ones unsigned, as in WAV."""
    if not frames:
        return b""
    whole = np.concatenate([np.array(ch, dtype=np.int64).T for _, ch in frames])
    width = (info.depth + 7) // 8
    if any(info.md5) and hashlib.md5(_packed(whole, width)).digest() != info.md5:
        raise ValueError("MD5 of the samples")
    return _packed(whole + 128, 1) if width == 1 else _packed(whole, width)


def _packed(whole: np.ndarray, width: int) -> bytes:
    raw = np.ascontiguousarray(whole, dtype="<i8").view(np.uint8).reshape(*whole.shape, 8)
    return raw[..., :width].tobytes()


def _scan(data: np.ndarray, infos: list[Info], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of the streams that decode_many can read in step: stream, byte place, header length.

    Candidates have the sync code, BLOCK samples, one 8-bit channel, a right CRC-8 and, in their
    stream, the number that is due. A stream is taken if all its samples are found that way.
    """
    at = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8))
    at = at[at + 16 < len(data)]
    at = at[(data[at + 2] == 0x14) & (data[at + 3] == 0x02)]
    stream = np.searchsorted(ends, at, side="right")
    ok = at >= (starts + np.array([i.first_frame for i in infos]))[stream]
    at, stream = at[ok], stream[ok]
    lead = data[at + 4].astype(np.int64)
    tail = np.select([lead < 0x80, lead >> 5 == 6, lead >> 4 == 14, lead >> 3 == 30, lead >> 2 == 62], [0, 1, 2, 3, 4], 0)
    number = np.where(lead < 0x80, lead, lead & ((1 << np.maximum(6 - tail, 0)) - 1))
    for k in range(1, 5):
        number = np.where(tail >= k, (number << 6) | (data[at + 4 + np.minimum(tail, k)] & 0x3F), number)
    head = 5 + tail
    if len(at):
        ok = crcs(data, at, head, 8) == data[at + head]
        at, stream, number, head = at[ok], stream[ok], number[ok], head[ok]
    count = np.bincount(stream, minlength=len(infos)) if len(at) else np.zeros(len(infos), np.int64)
    due = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    wrong = np.bincount(stream[number != due], minlength=len(infos)) if len(at) else count
    fits = np.array([i.channels == 1 and i.depth == 8 and i.max_block == BLOCK and i.total == c * BLOCK and not w for i, c, w in zip(infos, count, wrong, strict=True)], dtype=bool)
    keep = fits[stream] if len(at) else np.zeros(0, bool)
    return stream[keep], at[keep], head[keep]


def _decode_frames(data: np.ndarray, at: np.ndarray, head: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples, end place and whether each frame could be read here; data holds these frames only."""
    n = len(at)
    size = len(data) * 8
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    window = sum(padded[i : len(data) + i] << np.uint64(8 * (7 - i)) for i in range(8))

    def take(place: np.ndarray, width) -> np.ndarray:
        place = np.minimum(place, size - 1)
        w = np.asarray(width, dtype=np.uint64)
        v = (window[place >> 3] << (place & 7).astype(np.uint64)) >> np.minimum(np.uint64(64) - w, np.uint64(63))
        return np.where(w == 0, 0, v).astype(np.int64)

    def signed(v: np.ndarray, width) -> np.ndarray:
        return v - ((v >> (np.asarray(width) - 1)) << np.asarray(width))

    p = (at + head + 1) * 8
    first = take(p, 8)
    kind = first >> 1
    fine = (first & 1) == 0
    constant, verbatim = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    fine &= constant | verbatim | fixed | lpc
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    p = p + 8
    x = np.zeros((BLOCK, n), dtype=np.int64)
    for i in range(int(order.max(initial=0))):
        x[i] = np.where(order > i, signed(take(p + 8 * i, 8), 8), 0)
    x[:, constant] = signed(take(p[constant], 8), 8)
    for i in range(BLOCK if verbatim.any() else 0):
        x[i, verbatim] = signed(take(p[verbatim] + 8 * i, 8), 8)
    end = np.where(constant, p + 8, np.where(verbatim, p + 8 * BLOCK, p + 8 * order))
    taps = np.zeros((int(order.max(initial=0)), n), dtype=np.int64)
    shift = np.zeros(n, dtype=np.int64)
    for o in FIXED:
        for j, t in enumerate(FIXED[o][: len(taps)]):
            taps[j, fixed & (order == o)] = t
    if lpc.any():
        precision = take(end, 4) + 1
        shift = np.where(lpc, signed(take(end + 4, 5), 5), 0)
        for j in range(len(taps)):
            m = lpc & (order > j)
            taps[j, m] = signed(take(end + 9 + j * precision, precision), precision)[m]
        end = np.where(lpc, end + 9 + order * precision, end)
        fine &= shift >= 0
        shift = np.maximum(shift, 0)
    coded = fixed | lpc
    fine &= ~coded | (take(end, 6) == 0)  # one partition of 4-bit Rice codes
    rice = take(end + 6, 4)
    fine &= ~coded | (rice < 15)
    which = np.flatnonzero(coded & fine)
    q, k, o, s, t = end[which] + 10, rice[which], order[which], shift[which], taps[:, which]
    k64 = k.astype(np.uint64)
    back, hidden, none = np.uint64(63) - k64, np.int64(52), k == 0
    y, one, tail_bits = x[:, which], np.uint64(1), np.uint64(11)
    long = np.zeros(len(which), bool)
    for i in range(int(o.min(initial=0)), BLOCK):
        np.minimum(q, size - 1, out=q)
        v = window[q >> 3] << (q & 7).astype(np.uint64)
        # Zeros before the stop bit, from the exponent of the leading 53 bits.
        run = hidden + 1023 - ((v >> tail_bits).astype(np.float64).view(np.int64) >> 52)
        long |= run > LONGEST_RUN
        np.minimum(run, LONGEST_RUN, out=run)
        v = ((v << (run.astype(np.uint64) + one)) >> one) >> back
        v = v.astype(np.int64)
        v[none] = 0
        v |= run << k
        v = (v >> 1) ^ -(v & 1)
        for j in range(min(i, len(t))):
            if j == 0:
                guess = t[0] * y[i - 1]
            else:
                guess += t[j] * y[i - 1 - j]
        if min(i, len(t)):
            v += guess >> s
        if i < len(t):
            due = o <= i
            y[i] = np.where(due, v, y[i])
            q = np.where(due, q + run + 1 + k, q)
        else:
            y[i] = v
            q += run
            q += k
            q += 1
    fine[which[long]] = False
    x[:, which] = y
    end[which] = q
    end = (end + 7) >> 3
    fine &= (end + 2 <= bound) & (np.abs(x).max(0, initial=0) <= 128)
    return x.T, end, fine


def decode_many(medias: list[bytes]) -> list[bytes]:
    """PCM of each stream, checksums verified."""
    infos = [read_info(m) for m in medias]
    data = np.frombuffer(b"".join(medias), dtype=np.uint8)
    ends = np.cumsum([len(m) for m in medias])
    starts = ends - np.array([len(m) for m in medias], dtype=np.int64)
    stream, at, head = _scan(data, infos, starts, ends)
    count = np.bincount(stream, minlength=len(medias)) if len(at) else np.zeros(len(medias), np.int64)
    last = np.cumsum(count) - 1
    bound = np.append(at[1:], 0)
    bound[last[count > 0]] = ends[count > 0]
    good, samples = np.ones(len(at), bool), np.empty((len(at), BLOCK), np.int8)
    for a in range(0, len(at), CHUNK_FRAMES):
        z = min(a + CHUNK_FRAMES, len(at))
        base, top = int(at[a]), int(bound[a:z].max())
        x, end, fine = _decode_frames(data[base:top], at[a:z] - base, head[a:z], bound[a:z] - base)
        fine &= end + 2 == bound[a:z] - base
        if fine.any():
            own, tail = at[a:z][fine], end[fine] + base
            crc = crcs(data, own, tail - own, 16)
            fine[fine] = crc == (data[tail].astype(np.uint32) << 8 | data[tail + 1])
        samples[a:z] = np.where(fine[:, None], x, 0)
        good[a:z] = fine
    bad = np.bincount(stream[~good], minlength=len(medias)) if len(at) else count
    out = []
    for i, media in enumerate(medias):
        if not count[i] or bad[i]:  # reads the whole stream again and says what is wrong, if anything is
            info, frames = decode_stream(media)
            out.append(_pcm(info, frames))
            continue
        own = samples[last[i] - count[i] + 1 : last[i] + 1]
        if any(infos[i].md5) and hashlib.md5(own.tobytes()).digest() != infos[i].md5:
            raise ValueError("MD5 of the samples")
        out.append((own.view(np.uint8) ^ 0x80).tobytes())
    return out
