"""Lossless WebP (VP8L): a decoder for the whole format and an encoder for samples, and columns of stored media.

The decoder reads prefix codes (simple and normal, with their code-length codes), literals, back-references with
the two-dimensional distance codes, the colour cache and groups of codes, and inverts the predictor, cross-colour,
subtract-green and palette transforms. A stream whose codes all have one length each and that has neither
references nor a cache, as `encode_stream` writes, can be read by whole arrays; any other stream is read symbol by
symbol. The query's streams come from `compress_stream`, with Huffman codes, references, a cache and the transform
that makes the samples shortest, and are read symbol by symbol always.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, in_parts, text_of

#: Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES, MOST_BITS, CACHE_FACTOR, MOST_SIDE = 256, 24, 40, 15, 0x1E35A7BD, 16_384
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

#: A payload is filled up with FILL to a multiple of BLOCK bytes: rows of PIXELS pixels of three samples.
BLOCK, FILL, PIXELS = 576, b"\xff", 192

#: The longest copy, the farthest, as the largest distance code has it, and the sizes of the colour cache (in bits) that compress_stream tries.
MOST_LENGTH, MOST_BACK, CACHES = 4096, (1 << 20) - 120, (0, 6, 9)


@functools.cache
def near() -> list[tuple[int, int]]:
    """The 120 neighbours that short distance codes name: by distance, then the higher row, then the right side."""
    cells = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(cells, key=lambda c: (c[0] ** 2 + c[1] ** 2, -c[1], c[0] < 0))


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0

    def peek(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value


@functools.cache
def reversed_bits(width: int) -> np.ndarray:
    """For every number of `width` bits the one with its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


#: The numbers of 7 bits with their bits in reverse order.
BACKWARDS = reversed_bits(7).tolist()


class Code:
    """A canonical prefix code from the lengths of its symbols; an entry of the table is 16 * symbol + length."""

    def __init__(self, lengths):
        """`lengths`: those of all symbols, 0 for those that don't occur, or a pair of the symbols that do and theirs."""
        if isinstance(lengths, tuple):
            self.used, own = np.array(lengths[0], np.int64), np.array(lengths[1], np.int64)
        else:
            lengths = np.asarray(lengths)
            self.used = np.flatnonzero(lengths)
            own = lengths[self.used]
        if len(self.used) <= 1:
            self.used = self.used if len(self.used) else np.zeros(1, int)
            self.width, self.even = 0, 0
            self.entries = (self.used << 4).astype(np.uint16)
            return
        self.width = int(own.max())
        self.even = self.width if int(own.min()) == self.width else None
        share = 1 << (self.width - own)
        if share.sum() != 1 << self.width:
            raise ValueError("a prefix code isn't complete")
        order = own.argsort(kind="stable")
        in_order = (self.used << 4 | own).astype(np.uint16)[order].repeat(share[order])
        self.entries = in_order[reversed_bits(self.width)]

    @classmethod
    def made(cls, used: np.ndarray, width: int, even: int | None, entries: np.ndarray) -> Code:
        code = cls.__new__(cls)
        code.used, code.width, code.even, code.entries = used, width, even, entries
        return code

    @functools.cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    def read(self, bits: Bits) -> int:
        entry = self.table[bits.peek() & ((1 << self.width) - 1)]
        bits.at += entry & 15
        return entry >> 4


def small_table(lengths: list[int]) -> tuple[list[int], int]:
    """The table of Code and its width, for few symbols."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) <= 1:
        return [used[0][1] << 4 if used else 0], 0
    width = used[-1][0]
    size, code, table = 1 << width, 0, [0] * (1 << width)  # code: as its highest bits
    for n, s in used:
        if code >= size:
            break
        table[BACKWARDS[code << 7 - width] :: 1 << n] = [s << 4 | n] * (size >> n)
        code += size >> n
    if sum(size >> n for n, _ in used) != size:
        raise ValueError("a prefix code isn't complete")
    return table, width


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        symbols = [bits.take(8 if wide else 1)] + ([bits.take(8)] if two else [])
        if max(symbols) >= alphabet:
            raise ValueError("a symbol beyond the alphabet")
        symbols = sorted(set(symbols))
        return Code((symbols, [1] * len(symbols)))
    of_lengths = [0] * 19
    count = 4 + bits.take(4)
    ahead = bits.peek()  # 57 bits at least, as 19 lengths take
    for k in LENGTH_ORDER[:count]:
        of_lengths[k] = ahead & 7
        ahead >>= 3
    bits.take(3 * count)
    table, width = small_table(of_lengths)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    mask, data, place, ahead, here = (1 << width) - 1, bits.data, bits.at, 0, 0  # here: bits of `ahead` that are left
    used, own, at, before = [], [], 0, 8
    while at < alphabet and left:
        left -= 1
        if here < 14:
            if place > 8 * len(data):
                raise ValueError("the stream ends early")
            ahead, here = int.from_bytes(data[place >> 3 : (place >> 3) + 64], "little") >> (place & 7), 512 - (place & 7)
        entry = table[ahead & mask]
        n, symbol = entry & 15, entry >> 4
        ahead >>= n
        if symbol < 16:
            if symbol:
                used.append(at)
                own.append(symbol)
                before = symbol
            at += 1
            place += n
            here -= n
            continue
        value, more = ((before, 2), (0, 3), (0, 7))[symbol - 16]
        count = (11 if symbol == 18 else 3) + (ahead & ((1 << more) - 1))
        ahead >>= more
        place += n + more
        here -= n + more
        if at + count > alphabet:
            raise ValueError("code lengths run over")
        if value:
            used += range(at, at + count)
            own += [value] * count
        at += count
    bits.at = place
    if place > 8 * len(data):
        raise ValueError("the stream ends early")
    return Code((used, own))


#: What a symbol of the code of lengths says, shifted: further bits (by 4), the number of lengths without those (by 8), and the length (by
#: 16; 16: that before).
SAID = np.array([1 << 8 | n << 16 for n in range(16)] + [2 << 4 | 3 << 8 | 16 << 16, 3 << 4 | 3 << 8, 7 << 4 | 11 << 8])


def read_codes(asked: list[tuple[Bits, tuple[int, ...]]]) -> list[list[Code]]:
    """The next codes of many streams, each as read_code has them. A step reads the next code length of every stream."""
    out: list[list[Code]] = [[] for _ in asked]
    sizes = [len(bits.data) for bits, _ in asked]
    origin = 8 * (np.cumsum(sizes) - sizes)
    buffer = b"".join(bits.data for bits, _ in asked)
    words = np.ndarray((len(buffer) - 7,), "<i8", buffer, 0, (1,))
    for turn in range(max(len(a) for _, a in asked)):
        lane = np.array([k for k, (bits, _) in enumerate(asked) if not bits.peek() & 1])
        if len(lane):
            place = origin[lane] + [asked[k][0].at for k in lane]
            count = 4 + (words[place >> 3] >> (place & 7) >> 1 & 15)
            place += 5
            listed = (words[place >> 3] >> (place & 7))[:, None] >> 3 * np.arange(19) & 7
            listed[np.arange(19) >= count[:, None]] = 0
            place += 3 * count
            all_told = words[place >> 3] >> (place & 7) & 1 == 0  # else read alone
            lane, place, listed = lane[all_told], place[all_told] + 1, listed[all_told]
        if len(lane):
            of_lengths = np.zeros_like(listed)
            of_lengths[:, LENGTH_ORDER] = listed
            for k, (code, at) in zip(lane.tolist(), zip(*codes_at(words, place, of_lengths, np.array([asked[k][1][turn] for k in lane])), strict=True), strict=True):
                asked[k][0].at = int(at - origin[k])
                if asked[k][0].at > 8 * sizes[k]:
                    raise ValueError("the stream ends early")
                out[k].append(code)
        for k, (bits, alphabets) in enumerate(asked):
            if len(out[k]) == turn:
                out[k].append(read_code(bits, alphabets[turn]))
    return out


def tables(lane: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """The tables of Code for codes of two symbols or more each and of this width at most, one row per code."""
    share = 1 << (width - lengths)
    if (np.bincount(lane, share) != 1 << width).any():
        raise ValueError("a prefix code isn't complete")
    order = np.lexsort((symbols, lengths, lane))
    return (symbols << 4 | lengths)[order].repeat(share[order]).reshape(-1, 1 << width)[:, reversed_bits(width)]


def codes_at(words: np.ndarray, place: np.ndarray, of_lengths: np.ndarray, alphabet: np.ndarray) -> tuple[list[Code], np.ndarray]:
    """Codes whose lengths, coded by these lengths of 19 symbols, are at the given places, and the places behind them."""
    count, place = len(place), place.copy()
    table, several = np.zeros((count, 128), np.int64), (of_lengths > 0).sum(1) > 1
    table[~several] = (of_lengths[~several] > 0).argmax(1)[:, None] << 4
    if several.any():
        row, symbol = of_lengths[several].nonzero()
        table[several] = tables(row, symbol, of_lengths[several][row, symbol], 7)
    table = (table & 15 | SAID[table >> 4]).ravel()
    found, alive, at, before, here, end = [], np.arange(count), np.zeros(count, np.int64), np.full(count, 8), place, alphabet
    while len(alive):
        ahead = words[here >> 3] >> (here & 7)
        said = table[(ahead & 127) + (alive << 7)]
        n, more, value = said & 15, said >> 4 & 15, said >> 16
        many = (said >> 8 & 255) + (ahead >> n & (1 << more) - 1)
        value = np.where(value == 16, before, value)
        real = value.nonzero()[0]
        found.append((alive[real], at[real], many[real], value[real]))
        before[real] = value[real]
        here, at = here + n + more, at + many
        going = at < end
        if not going.all():
            if (at > end).any():
                raise ValueError("code lengths run over")
            place[alive[~going]] = here[~going]
            alive, at, before, here, end = alive[going], at[going], before[going], here[going], end[going]
    lane, first, many, value = map(np.concatenate, zip(*found, strict=True))
    lane, value = lane.repeat(many), value.repeat(many)
    symbol = first.repeat(many) + np.arange(len(lane)) - (many.cumsum() - many).repeat(many)
    order = np.lexsort((symbol, lane))
    lane, symbol, value = lane[order], symbol[order], value[order]
    bounds = np.searchsorted(lane, np.arange(count + 1))
    used, codes = np.diff(bounds), np.empty(count, object)
    for k in (used < 2).nonzero()[0]:
        codes[k] = Code((symbol[bounds[k] : bounds[k + 1]], value[bounds[k] : bounds[k + 1]]))
    rest = (used > 1).nonzero()[0]
    widths, least = np.zeros(count, np.int64), np.zeros(count, np.int64)
    widths[rest], least[rest] = (f.reduceat(value, bounds[rest]) if len(rest) else 0 for f in (np.maximum, np.minimum))
    widths[used < 2] = 0
    for width in np.unique(widths[rest]).tolist():
        some = (widths == width).nonzero()[0]
        mine = (widths == width)[lane]
        entries = tables(np.searchsorted(some, lane[mine]), symbol[mine], value[mine], width).astype(np.uint16)
        for k, own in zip(some.tolist(), entries, strict=True):
            codes[k] = Code.made(symbol[bounds[k] : bounds[k + 1]], width, width if least[k] == width else None, own)
    return codes.tolist(), place


#: For every prefix code of a length or a distance its smallest value and the number of further bits.
AMOUNTS = [(k + 1, 0) if k < 4 else (((2 + (k & 1)) << ((k - 2) >> 1)) + 1, (k - 2) >> 1) for k in range(DISTANCES)]


def read_amount(bits: Bits, prefix: int) -> int:
    least, more = AMOUNTS[prefix]
    return least + bits.take(more)


def read_even(bits: Bits, codes: list[Code], count: int) -> np.ndarray:
    """Pixels of a stream in which each code has a single length: every pixel has the same number of bits."""
    widths = [c.even for c in codes[:4]]
    each = sum(widths)
    out = np.empty((count, 4), np.uint8)
    if each:
        first, last = bits.at >> 3, (bits.at + count * each + 7) >> 3
        raw = np.frombuffer(bits.data, np.uint8)[first:last]
        flat = np.unpackbits(raw, bitorder="little")[bits.at & 7 :][: count * each]
        if len(flat) < count * each:
            raise ValueError("the stream ends early")
        flat = flat.reshape(count, each)
    at = 0
    for k, (code, n) in enumerate(zip(codes, widths, strict=False)):
        where = (1, 0, 2, 3)[k]  # codes come as green, red, blue, alpha
        if n:
            rank = np.packbits(flat[:, at : at + n], axis=1)[:, 0] >> (8 - n)
            out[:, where] = code.used.astype(np.uint8)[rank]
        else:
            out[:, where] = code.used[0]
        at += n
    bits.at += count * each
    return out


def words_from(data: bytes, at: int, most: int = 1 << 16) -> list[int]:
    """The 8 bytes from each of the next places on, as numbers."""
    count = min(len(data) - 7 - at, most)
    if count <= 0:
        raise ValueError("the stream ends early")
    return np.ndarray((count,), "<u8", data, at, (1,)).tolist()


def read_image(bits: Bits, width: int, height: int, main: bool, arrays: bool = True) -> np.ndarray:
    """An entropy-coded image as (height, width, 4) samples in the order red, green, blue, alpha.

    `arrays`: whether a stream of equal lengths may be read by whole arrays.
    """
    return alone(reading(bits, width, height, main, arrays))


def alone(steps):
    """What a generator of codes and images to read gives in the end, each of them read as it comes."""
    try:
        asked = next(steps)
        while True:
            asked = steps.send([read_code(asked[0], n) for n in asked[1]] if len(asked) == 2 else read_single(*asked))
    except StopIteration as e:
        return e.value


def abreast(many: list) -> list:
    """The same for many generators at once; the codes and images that they wait for are read side by side."""
    out, sent, images = [None] * len(many), dict.fromkeys(range(len(many))), {}
    while sent or images:
        codes = {}
        for k, found in sent.items():
            try:
                asked = many[k].send(found)
                (codes if len(asked) == 2 else images)[k] = asked
            except StopIteration as e:
                out[k] = e.value
        try:
            if codes:  # images wait for those that still have codes to read
                sent = dict(zip(codes, read_codes(list(codes.values())), strict=True))
                continue
            fit = [k for k, i in images.items() if i[3][3].width == 0]
            sent = dict(zip(fit, read_abreast([images[k] for k in fit]), strict=True)) if len(fit) >= ABREAST else {}
        except IndexError:
            raise ValueError("the stream ends early") from None
        sent |= {k: read_single(*i) for k, i in images.items() if k not in sent}
        images = {}
    return out


def reading(bits: Bits, width: int, height: int, main: bool, arrays: bool):
    """The steps of read_image: bits and the alphabets of codes to be read, and what read_single takes, are asked for."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11 or cache_bits < 0:
        raise ValueError("colour cache too large")
    side, groups, which = 0, 1, None
    if main and bits.take(1):
        side = bits.take(3) + 2
        meta = yield from reading(bits, -(-width >> side), -(-height >> side), False, arrays)
        which = meta[:, :, 0].astype(int) << 8 | meta[:, :, 1]
        groups = int(which.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    alphabets = (LITERALS + LENGTHS + cache_size, LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = []
    for _ in range(groups):
        codes.append((yield bits, alphabets))
    count = width * height
    one = codes[0]
    if arrays and groups == 1 and not cache_bits and all(c.even is not None and c.even <= 8 for c in one[:4]) and one[0].used[-1] < LITERALS:
        return read_even(bits, one, count).reshape(height, width, 4)
    pixels = read_grouped(bits, width, count, codes, which, side, cache_bits) if which is not None else (yield bits, width, count, one, cache_bits)
    return np.array(pixels, "<u4").view(np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]


def seen_again(pixels: list[int], back: int, length: int) -> list[int]:
    """What a reference copies from the end of the pixels; it may run into its own copy."""
    part = pixels[-back:] if back <= length else pixels[-back : length - back]
    return part if len(part) == length else (part * (length // back + 1))[:length]


@functools.lru_cache(64)
def steps_of(width: int) -> list[int]:
    """The distances that short codes name, from code 1 on."""
    return [0, *(max(1, dx + dy * width) for dx, dy in near())]


def read_single(bits: Bits, width: int, count: int, codes: list[Code], cache_bits: int, pixels=(), cache=None) -> list[int]:
    """Pixels of an image with one group of codes, symbol by symbol. A symbol with all that belongs to it is cut from 57 bits that
    are looked at together; only a copy with a long length code looks again. The first pixels and the cache after them may be given."""
    (of_green, m_green), (of_red, m_red), (of_blue, m_blue), (of_alpha, m_alpha), (of_far, m_far) = ((memoryview(c.entries), (1 << c.width) - 1) for c in codes)
    pixels = list(pixels)
    cache, cache_at, beside = cache or [0] * (1 << cache_bits), LITERALS + LENGTHS, 32 - cache_bits
    data, place, start, words, limit, append = bits.data, bits.at, 0, [], 0, pixels.append
    steps = steps_of(width)
    opaque, literals = of_alpha[0] >> 4 << 24, LITERALS << 4
    at = len(pixels)
    while at < count:
        k = (place >> 3) - start
        if k >= limit:
            start, words, k = place >> 3, words_from(data, place >> 3), 0
            limit = len(words)
        ahead = words[k] >> (place & 7)
        entry = of_green[ahead & m_green]
        n = entry & 15
        ahead >>= n
        if entry < literals:
            red = of_red[ahead & m_red]
            ahead >>= red & 15
            blue = of_blue[ahead & m_blue]
            place += n + (red & 15) + (blue & 15)
            if m_alpha:
                bits.at = place
                opaque = codes[3].read(bits) << 24
                place = bits.at
            p = opaque | (red & ~15) << 12 | (entry & ~15) << 4 | blue >> 4
            if cache_bits:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> beside] = p
            append(p)
            at += 1
            continue
        symbol = entry >> 4
        if symbol < cache_at:
            least, more = AMOUNTS[symbol - LITERALS]
            length = least + (ahead & ((1 << more) - 1))
            ahead >>= more
            n += more
            if n > 24:
                place, n = place + n, 0
                k = (place >> 3) - start
                if k >= limit:
                    start, words, k = place >> 3, words_from(data, place >> 3), 0
                    limit = len(words)
                ahead = words[k] >> (place & 7)
            far = of_far[ahead & m_far]
            least, more = AMOUNTS[far >> 4]
            back = least + (ahead >> (far & 15) & ((1 << more) - 1))
            place += n + (far & 15) + more
            back = back - 120 if back > 120 else steps[back]
            if back > at or at + length > count:
                raise ValueError("a reference leaves the image")
            copied = seen_again(pixels, back, length)
            pixels += copied
            if cache_bits:
                for p in copied[-back:]:  # what comes before them comes again
                    cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> beside] = p
            at += length
        else:  # what comes from the cache stays in its place there, unless that was empty
            place += n
            p = cache[symbol - cache_at]
            if not p:
                cache[0] = 0
            append(p)
            at += 1
    if place > 8 * len(data):  # eight bytes more than there are: words_from() refuses what is beyond them
        raise ValueError("the stream ends early")
    bits.at = place
    return pixels


#: Images that are read side by side at least, and flags and further numbers in the entries of their tables.
ABREAST, CACHED, COPIED, KEY = 32, 1 << 30, 3 << 29, (1 << 20) - 1


def lane_tables(codes: list[list[Code]]) -> np.ndarray:
    """The tables of green of all images in a row, then those of red, then those of blue: 64 times what an entry adds to a pixel, plus
    the bits that it takes."""
    green, red, blue = (np.concatenate([c.entries for c in own]).astype(np.int32) for own in zip(*(c[:3] for c in codes), strict=True))
    symbol = green >> 4
    other = np.where(symbol < LITERALS + LENGTHS, COPIED | (symbol - LITERALS) << 6, CACHED | (symbol - LITERALS - LENGTHS) << 6)
    green = np.where(symbol < LITERALS, symbol << 14, other) | green & 15
    return np.concatenate([green, (red >> 4) << 22 | red & 15, (blue >> 4) << 6 | blue & 15], dtype=np.int32)


def read_abreast(images: list[tuple]) -> list[np.ndarray]:
    """Pixels of many images, each as read_single has them: (bits, width, count, codes, cache_bits), with one value of alpha each.
    A step reads the next symbol of every image that isn't done; the last few are read one by one."""
    starts = lambda sizes: np.cumsum([0, *sizes])[:-1]
    count, table = np.array([i[2] for i in images]), lane_tables([i[3] for i in images])
    buffer = b"".join(i[0].data for i in images)
    words = np.ndarray((len(buffer) - 7,), "<i8", buffer, 0, (1,))
    found, first, origin = np.empty(count.sum(), np.int64), starts(count), 8 * starts(len(i[0].data) for i in images)
    sizes = np.array([[1 << c.width for c in i[3][:3]] for i in images]).T
    at_tables, far = starts(sizes.ravel()).reshape(3, -1), [(memoryview(i[3][4].entries), (1 << i[3][4].width) - 1) for i in images]
    cache, caches = np.zeros(sum(1 << i[4] for i in images), np.int64), starts(1 << i[4] for i in images)
    lanes = np.stack([
        np.arange(len(images)), origin + [i[0].at for i in images], first, first + count, *at_tables, *(sizes - 1),
        caches, np.array([32 - i[4] for i in images]), np.array([int(i[3][3].entries[0]) >> 4 << 24 for i in images])])
    lane, place, at, end, green_at, red_at, blue_at, m_green, m_red, m_blue, in_cache, beside, alpha = lanes
    while len(lane) >= ABREAST:
        ahead = words[place >> 3] >> (place & 7)
        green = table[(ahead & m_green) + green_at]
        ahead >>= green & 63
        red = table[(ahead & m_red) + red_at]
        ahead >>= red & 63
        plain = green < CACHED
        symbol = green + (red + table[(ahead & m_blue) + blue_at]) * plain
        place += symbol & 63
        pixel = symbol >> 6 | alpha
        copies = ()
        if not plain.all():
            special = (~plain).nonzero()[0]
            copied = green[special] >= COPIED
            pixel[special] = cache[in_cache[special] + np.where(copied, 0, symbol[special] >> 6 & KEY)]
            copies = special[copied].tolist()
            for k in copies:  # the pixel before it is in the cache already
                pixel[k] = found[at[k] - 1]
        cache[in_cache + ((CACHE_FACTOR * pixel & 0xFFFFFFFF) >> beside)] = pixel
        found[at] = pixel
        at += 1
        for k in copies:
            i, start, where = int(lane[k]), int(at[k]) - 1, int(place[k])
            ahead = int(words[where >> 3]) >> (where & 7)
            least, more = AMOUNTS[int(symbol[k]) >> 6 & 31]
            length = least + (ahead & (1 << more) - 1)
            ahead, where = ahead >> more, where + more
            entry = far[i][0][ahead & far[i][1]]
            least, more = AMOUNTS[entry >> 4]
            back = least + (ahead >> (entry & 15) & (1 << more) - 1)
            back = back - 120 if back > 120 else steps_of(images[i][1])[back]
            if back > start - first[i] or start + length > end[k]:
                raise ValueError("a reference leaves the image")
            source = found[start - back : start - back + min(back, length)]
            found[start : start + length] = source if back >= length else np.resize(source, length)
            last = found[start + max(0, length - back) : start + length]
            cache[in_cache[k] + ((CACHE_FACTOR * last & 0xFFFFFFFF) >> beside[k])] = last  # of values for one place the last stays
            place[k], at[k] = where + (entry & 15) + more, start + length
        going = at < end
        if not going.all():
            for k in (~going).nonzero()[0].tolist():
                bits = images[lane[k]][0]
                bits.at = int(place[k] - origin[lane[k]])
                if bits.at > 8 * len(bits.data):
                    raise ValueError("the stream ends early")
            lanes = lanes[:, going]
            lane, place, at, end, green_at, red_at, blue_at, m_green, m_red, m_blue, in_cache, beside, alpha = lanes
    for k, i in enumerate(lane.tolist()):
        bits, width, size, codes, cache_bits = images[i]
        bits.at = int(place[k] - origin[i])
        kept = cache[in_cache[k] : in_cache[k] + (1 << cache_bits)].tolist()
        found[first[i] : first[i] + size] = read_single(bits, width, size, codes, cache_bits, found[first[i] : at[k]].tolist(), kept)
    return np.split(found, first[1:])


def read_grouped(bits: Bits, width: int, count: int, codes: list[list[Code]], which: np.ndarray, side: int, cache_bits: int) -> list[int]:
    """Pixels of an image whose squares have groups of codes of their own."""
    pixels: list[int] = []
    cache, cached = [0] * (1 << cache_bits), 0
    while len(pixels) < count:
        at = len(pixels)
        y, x = divmod(at, width)
        green, red, blue, alpha, distance = codes[which[y >> side, x >> side]]
        symbol = green.read(bits)
        if symbol < LITERALS:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            pixels.append(a << 24 | r << 16 | symbol << 8 | b)
        elif symbol < LITERALS + LENGTHS:
            length = read_amount(bits, symbol - LITERALS)
            back = read_amount(bits, distance.read(bits))
            if back > 120:
                back -= 120
            else:
                dx, dy = near()[back - 1]
                back = max(1, dx + dy * width)
            if back > at or at + length > count:
                raise ValueError("a reference leaves the image")
            pixels += seen_again(pixels, back, length)
        else:
            for p in pixels[cached:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = at
            pixels.append(cache[symbol - LITERALS - LENGTHS])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
    return pixels


# Inverse transforms; samples are (height, width, 4) in the order red, green, blue, alpha.


def average(a, b):
    return (a + b) >> 1


def predicted(mode: int, left, top, right, corner):
    """The prediction of one pixel from its left, top, top-right and top-left neighbours (int arrays of 4)."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return average(average(left, right), top)
        case 6:
            return average(left, corner)
        case 7:
            return average(left, top)
        case 8:
            return average(corner, top)
        case 9:
            return average(top, right)
        case 10:
            return average(average(left, corner), average(top, right))
        case 11:
            return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
        case 12:
            return np.clip(left + top - corner, 0, 255)
        case 13:
            mean = average(left, top)
            return np.clip(mean + ((mean - corner) / 2).astype(int), 0, 255)
    return np.array([0, 0, 0, 255])


def predictor_mode(modes: np.ndarray, side: int, x: int, y: int) -> int:
    if not y:
        return 1 if x else 0
    return int(modes[y >> side, x >> side, 1] & 15) if x else 2


def neighbours(image: np.ndarray, x: int, y: int):
    """Of a pixel: left, top, top-right (in the last column, the first pixel of its own row) and top-left."""
    width = image.shape[1]
    right = (image[y - 1, x + 1] if x + 1 < width else image[y, 0]) if y else image[0, 0]
    return image[y, x - 1], image[y - 1, x], right, image[y - 1, x - 1]


def undo_predictor(image: np.ndarray, side: int, modes: np.ndarray) -> np.ndarray:
    out = image.astype(int)
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            mode = predictor_mode(modes, side, x, y)
            out[y, x] = (out[y, x] + predicted(mode, *neighbours(out, x, y))) & 255
    return out.astype(np.uint8)


def spread(data: np.ndarray, side: int, shape) -> np.ndarray:
    return data.repeat(1 << side, 0).repeat(1 << side, 1)[: shape[0], : shape[1]]


def colour_shift(factor: np.ndarray, channel: np.ndarray) -> np.ndarray:
    return factor.astype(np.int8).astype(int) * channel.astype(np.uint8).astype(np.int8).astype(int) >> 5


def undo_cross_colour(image: np.ndarray, side: int, factors: np.ndarray) -> np.ndarray:
    """Factors are stored as blue: green to red, green: green to blue, red: red to blue."""
    f, out = spread(factors, side, image.shape), image.astype(int)
    green = image[:, :, 1]
    out[:, :, 0] = (out[:, :, 0] + colour_shift(f[:, :, 2], green)) & 255
    out[:, :, 2] = (out[:, :, 2] + colour_shift(f[:, :, 1], green) + colour_shift(f[:, :, 0], out[:, :, 0])) & 255
    return out.astype(np.uint8)


def undo_subtract_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[:, :, 0] += image[:, :, 1]
    out[:, :, 2] += image[:, :, 1]
    return out


def palette_bits(size: int) -> int:
    """Several indices share a pixel when the palette is small: 2**bits of them."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def undo_palette(image: np.ndarray, width: int, colours: np.ndarray) -> np.ndarray:
    share = palette_bits(len(colours))
    each, per = 8 >> share, 1 << share
    green = image[:, :, 1]
    shifts = each * np.arange(per)
    index = (green[:, :, None] >> shifts.astype(np.uint8)) & ((1 << each) - 1)
    index = index.reshape(len(green), -1)[:, :width]
    table = np.zeros((256, 4), np.uint8)  # an index beyond the palette is transparent black
    table[: len(colours)] = colours
    return table[index]


@dataclass
class Transform:
    kind: int
    width: int
    side: int = 0
    data: np.ndarray | None = None


def decode_stream(data: bytes, arrays: bool = True) -> np.ndarray:
    """(height, width, 4) samples, red, green, blue, alpha, of a VP8L stream."""
    return alone(decoding(data, arrays))


def decoding(data: bytes, arrays: bool):
    """The steps of decode_stream."""
    bits = Bits(data)
    if bits.take(8) != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    opaque = not bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    transforms: list[Transform] = []
    coded = width
    while bits.take(1):
        kind = bits.take(2)
        if any(t.kind == kind for t in transforms):
            raise ValueError("a transform comes twice")
        t = Transform(kind, coded)
        if kind in (PREDICTOR, CROSS_COLOUR):
            t.side = bits.take(3) + 2
            t.data = read_image(bits, -(-coded >> t.side), -(-height >> t.side), False, arrays)
        elif kind == PALETTE:
            size = bits.take(8) + 1
            t.data = read_image(bits, size, 1, False, arrays)[0].cumsum(0, dtype=np.uint8)
            coded = -(-coded >> palette_bits(size))
        transforms.append(t)
    image = yield from reading(bits, coded, height, True, arrays)
    for t in reversed(transforms):
        if t.kind == PREDICTOR:
            image = undo_predictor(image, t.side, t.data)
        elif t.kind == CROSS_COLOUR:
            image = undo_cross_colour(image, t.side, t.data)
        elif t.kind == SUBTRACT_GREEN:
            image = undo_subtract_green(image)
        else:
            image = undo_palette(image, t.width, t.data)
    if opaque:
        image = image.copy()
        image[:, :, 3] = 255
    return image


def chunks(file: bytes):
    """(tag, data) of the chunks of RIFF files that follow each other, and where each file starts."""
    at = 0
    while at < len(file):
        if file[at : at + 4] != b"RIFF" or file[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + int.from_bytes(file[at + 4 : at + 8], "little")
        inner = at + 12
        while inner < end:
            size = int.from_bytes(file[inner + 4 : inner + 8], "little")
            yield file[inner : inner + 4], file[inner + 8 : inner + 8 + size]
            inner += 8 + size + (size & 1)
        at = end + (end - at & 1)


def decode(file: bytes, arrays: bool = True) -> list[np.ndarray]:
    """The pixel arrays of the lossless images in a file or several files in a row."""
    return [decode_stream(data, arrays) for tag, data in chunks(file) if tag == b"VP8L"]


# The encoder: each channel's values get codes of one length, so that any stretch can be written and read at once.


class Writer:
    """Numbers with their numbers of bits, lowest bits first; they become bytes all at once."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.few: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.few.append((value, n))

    def put_bits(self, bits: np.ndarray) -> None:
        if self.few:
            number = at = 0
            for value, n in self.few:
                number |= value << at
                at += n
            self.few = []
            self.put_bits(np.unpackbits(np.frombuffer(number.to_bytes(at + 7 >> 3, "little"), np.uint8), count=at, bitorder="little"))
        self.parts.append(bits)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Write each value with its own number of bits."""
        ends = sizes.cumsum()
        place = np.arange(ends[-1] if len(ends) else 0) - (ends - sizes).repeat(sizes)
        self.put_bits((values.repeat(sizes) >> place & 1).astype(np.uint8))

    def bytes(self) -> bytes:
        self.put_bits(np.zeros(0, np.uint8))
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def put_even_code(w: Writer, used: np.ndarray, alphabet: int) -> tuple[np.ndarray, int]:
    """Write a code for the used values; gives the code of each value and the number of its bits."""
    if len(used) == 1:
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(int(used[0]), 8)
        return np.zeros(256, np.uint8), 0
    n = max(1, int(len(used) - 1).bit_length())
    have = np.zeros(256, bool)
    have[used] = True
    have[np.flatnonzero(~have)[: (1 << n) - len(used)]] = True  # the code has to be complete
    w.put(0, 1)
    lengths = {n: 1} if alphabet == 256 and n == 8 else {0: 1, n: 1}
    last = max(LENGTH_ORDER.index(k) for k in lengths)
    w.put(max(0, last - 3), 4)
    for k in LENGTH_ORDER[: max(4, last + 1)]:
        w.put(lengths.get(k, 0), 3)
    w.put(0, 1)
    if len(lengths) == 2:
        w.put_bits(np.concatenate([have.astype(np.uint8), np.zeros(alphabet - 256, np.uint8)]))
    return (np.cumsum(have) - 1).astype(np.uint8), n


def encode_stream(image: np.ndarray) -> bytes:
    """A VP8L stream of (height, width, 3) samples, opaque."""
    height, width, _ = image.shape
    w = Writer()
    w.put(SIGNATURE, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(0, 4)
    w.put(0, 3)  # no transforms, no colour cache, one group of codes
    fields = []
    for k, alphabet in ((1, LITERALS + LENGTHS), (0, LITERALS), (2, LITERALS)):
        values = image[:, :, k].ravel()
        code, n = put_even_code(w, np.flatnonzero(np.bincount(values, minlength=256)), alphabet)
        if n:
            fields.append(np.unpackbits(code[values][:, None], axis=1)[:, 8 - n :])
    put_even_code(w, np.array([255]), LITERALS)
    put_even_code(w, np.array([0]), DISTANCES)
    if fields:
        w.put_bits(np.concatenate(fields, axis=1).ravel())
    return w.bytes()


# The encoder of the whole method: Huffman codes, references, colour cache, and the transform that gives the fewest bits. It works
# on many images at once, each with codes of its own: arrays hold the pixels, symbols or codes of all of them, one image after another.

#: Images and pixels (but for one larger image) that are encoded at once.
TOGETHER, MOST_PIXELS = 128, 1 << 17


def code_lengths(owner: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of at most `most` bits of complete codes for two or more symbols each; `owner` says, in order, whose code a symbol is
    in, from 0 on. Leaves and inner nodes are two queues, each in order, so the two smallest nodes are at their fronts; a step
    joins two nodes of every code that has some left."""
    sizes = np.bincount(owner)
    row = np.empty(len(sizes), np.int64)
    row[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))  # large codes come first
    order = np.lexsort((counts, owner))
    widest, falling = int(sizes.max()), -np.sort(-sizes)
    wide = 2 * widest + 1  # leaves, one place after them, inner nodes
    leaf = row[owner] * wide + np.arange(len(owner)) - (sizes.cumsum() - sizes)[owner]
    weights, above = np.full(len(sizes) * wide, 1 << 60), np.zeros(len(sizes) * wide, np.int64)
    weights[leaf] = counts[order]
    a = np.arange(len(sizes)) * wide
    inner = a + widest + 1
    b = inner.copy()
    left = np.searchsorted(-falling, -np.arange(1, widest + 1) - 1, "right").tolist()  # codes that have so many steps
    for new, m in enumerate(left[: widest - 1]):
        at = inner[:m] + new
        total = 0
        for _ in range(2):
            one, other = weights[a[:m]], weights[b[:m]]
            first = one <= other
            above[np.where(first, a[:m], b[:m])] = at
            total = total + np.minimum(one, other)
            a[:m] += first
            b[:m] += ~first
        weights[at] = total
    depth = np.ones(len(weights), np.int64)
    for k in range(widest - 3, -1, -1):
        at = inner[: left[k + 1]] + k
        depth[at] = depth[above[at]] + 1
    lengths = np.empty(len(owner), np.int64)
    lengths[order] = depth[above[leaf]]
    over = np.zeros(len(sizes), bool)
    over[owner[lengths > most]] = True
    if over.any():
        again = over[owner]
        lengths[again] = code_lengths((over.cumsum() - 1)[owner[again]], (counts[again] >> 1) + 1, most)
    return lengths


def canonical(owner: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol as a number whose lowest bit is written first; symbols come in order within their codes."""
    order = np.lexsort((lengths, owner))
    share = 1 << (MOST_BITS - lengths[order])
    ends = share.cumsum()
    starts = np.append(True, owner[1:] != owner[:-1]).nonzero()[0]  # as whose symbols are together in any order
    before = (ends - share)[starts].repeat(np.diff(np.append(starts, len(owner))))
    out = np.empty(len(owner), np.int64)
    out[order] = reversed_bits(MOST_BITS)[ends - share - before]  # the highest bits come first, and the rest are zeros
    return out


@functools.cache
def zeros() -> np.ndarray:
    """For every number of symbols without a code what says so in the code of lengths: up to 8 times the symbol, value and further bits."""
    out = np.full((LITERALS + LENGTHS + (1 << max(CACHES)) + 1, 8, 3), -1)
    for count in range(len(out)):
        k, left = 0, count
        while left:
            some = min(left, 138) if left >= 3 else 1
            out[count, k] = (0, 0, 0) if some < 3 else (17, some - 3, 3) if some < 11 else (18, some - 11, 7)
            k, left = k + 1, left - some
    return out


def put_codes(code: np.ndarray, symbol: np.ndarray, counts: np.ndarray, alphabets: np.ndarray):
    """Codes for symbols that come so often. `code` says, in order, which code a symbol is in; `alphabets` has one entry per code.

    Gives what says how the codes are (code, value and bits, in order within a code), and the code and number of bits of each symbol.
    """
    used = np.bincount(code, minlength=len(alphabets))
    several = used > 1
    heads, head_sizes = np.full(len(used), 0b101), np.full(len(used), 11)  # a symbol alone
    heads[code] |= np.where(several[code], 0, symbol << 3)
    values, sizes = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    many = several[code]
    if not many.any():
        return np.arange(len(used)), heads, head_sizes, values, sizes
    owner, at, ids = (several.cumsum() - 1)[code[many]], symbol[many], several.nonzero()[0]
    own = code_lengths(owner, counts[many], MOST_BITS)
    values[many], sizes[many] = canonical(owner, own), own

    starts = np.append(True, owner[1:] != owner[:-1])
    last = np.append(starts[1:], True)
    gap = at - np.where(starts, -1, np.append(-1, at[:-1])) - 1
    tail = alphabets[ids] - at[last] - 1
    # Nine places for each symbol, eight for those between it and the one before it; then eight for those after the last.
    tokens = np.concatenate([zeros()[gap], np.stack([own, 0 * own, 0 * own], 1)[:, None]], 1).reshape(-1, 3)
    tokens = np.concatenate([tokens, zeros()[tail].reshape(-1, 3)])
    whose = np.concatenate([owner.repeat(9), np.arange(len(ids)).repeat(8)])
    real = (tokens[:, 0] >= 0).nonzero()[0]
    tokens, whose = tokens[real], whose[real]
    order = np.argsort(whose, kind="stable")
    tokens, whose = tokens[order], whose[order]
    often = np.bincount(whose * 19 + tokens[:, 0], minlength=19 * len(ids)).reshape(-1, 19)
    of_lengths, codes, taken = np.zeros(often.shape, np.int64), np.zeros(often.shape, np.int64), np.zeros(often.shape, np.int64)
    of_lengths[often > 0] = 1
    some = (often > 0).sum(1) > 1
    if some.any():
        row, kind = (often * some[:, None]).nonzero()
        dense = (some.cumsum() - 1)[row]
        lengths = code_lengths(dense, often[row, kind], 7)
        of_lengths[row, kind] = taken[row, kind] = lengths
        codes[row, kind] = canonical(dense, lengths)
    listed = of_lengths[:, LENGTH_ORDER]
    count = np.maximum(4, 19 - (listed[:, ::-1] > 0).argmax(1))
    heads[ids] = count - 4 << 1 | (listed << (5 + 3 * np.arange(19))).sum(1)
    head_sizes[ids] = 5 + 3 * count + 1
    kind = tokens[:, 0]
    shift = taken[whose, kind]
    all_code = np.concatenate([np.arange(len(used)), ids[whose]])
    all_values = np.concatenate([heads, codes[whose, kind] | tokens[:, 1] << shift])
    return all_code, all_values, np.concatenate([head_sizes, shift + tokens[:, 2]]), values, sizes


def amounts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix codes, further bits and their numbers of lengths or distances."""
    v = values - 1
    n = np.frexp(np.maximum(v, 1).astype(float))[1].astype(np.int64) - 1  # floor of the logarithm
    more = np.maximum(n - 1, 0)
    half = v >> more & 1
    large = v >= 4
    return np.where(large, 2 * n + half, v), np.where(large, v - ((2 + half) << more), 0), np.where(large, more, 0)


@functools.cache
def short_distances(width: int) -> np.ndarray:
    """For every distance that a short code names that code, else 0."""
    out = np.zeros(8 * width + 9, np.int64)
    for k, (dx, dy) in list(enumerate(near(), 1))[::-1]:
        out[max(1, dx + dy * width)] = k
    return out


def earlier(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every place the last one before it with the same key and the same owner, -1 if there is none."""
    order = np.argsort(keys, kind="stable")
    if owner[0] != owner[-1]:
        order = order[np.argsort(owner[order], kind="stable")]
    out = np.full(len(keys), -1)
    keys, whose = keys[order], owner[order]
    same = (keys[1:] == keys[:-1]) & (whose[1:] == whose[:-1])
    out[order[1:][same]] = order[:-1][same]
    return out


def references(flat: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of copies of 3 pixels or more, from left to right, each from the last equal triple of its image.
    A copy goes on as long as the next triples are equal at the same distance."""
    ends = counts.cumsum()
    own = (np.arange(len(flat)) < (ends - 2)[owner]) & (counts > 3)[owner]  # a triple starts here
    triple = own.nonzero()[0]
    none = np.zeros(0, np.int64)
    if not len(triple):
        return none, none, none
    x = flat.astype(np.uint64)
    key = x[triple] * np.uint64(0x9E3779B97F4A7C15) + x[triple + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[triple + 2] * np.uint64(0x165667B19E3779F9)
    key ^= key >> np.uint64(29)
    # Few keys of 16 bits sort fastest, but in a long image they would hide equal triples behind others.
    long, before = (counts - 2 >= 1 << 14)[owner[triple]], np.full(len(triple), -1)
    for part, kind in ((~long).nonzero()[0], np.uint16), (long.nonzero()[0], np.uint64):
        if len(part):
            short = key[part] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48) if kind is np.uint16 else key[part]
            found = earlier(short.astype(kind), owner[triple[part]])
            before[part] = np.where(found < 0, -1, part[found])
    have = (before >= 0).nonzero()[0]
    at, source = triple[have], triple[before[have]]
    met = (flat[source] == flat[at]) & (flat[source + 1] == flat[at + 1]) & (flat[source + 2] == flat[at + 2]) & (at - source <= MOST_BACK)
    at, source = at[met], source[met]
    if not len(at):
        return none, none, none
    back = np.zeros(len(flat), np.int64)
    back[at] = at - source
    changes = (back[1:] != back[:-1]).nonzero()[0]
    length = np.minimum(changes[np.searchsorted(changes, at)] - at + 3, MOST_LENGTH)
    chosen, k, after = [], 0, np.searchsorted(at, at + length).tolist()
    while k < len(after):
        chosen.append(k)
        k = after[k]
    return at[chosen], length[chosen], back[at[chosen]]


@functools.cache
def products() -> np.ndarray:
    """Numbers times their logarithms."""
    c = np.arange(1 << 16, dtype=float)
    return c * np.log2(np.maximum(c, 1))


def entropies(counts: np.ndarray) -> np.ndarray:
    """Bits of all symbols together, by rows of counts."""
    total = counts.sum(1)
    if total.max() < len(products()):
        return products()[total] - products()[counts].sum(1)
    c, total = counts.astype(float), total.astype(float)
    return total * np.log2(np.maximum(total, 1)) - (c * np.log2(np.maximum(c, 1))).sum(1)


def counted(owner: np.ndarray, values: np.ndarray, rows: int, width: int) -> np.ndarray:
    """How often each owner has each value."""
    return np.bincount(owner * np.int64(width) + values, minlength=rows * width).reshape(rows, width)


def put_pixels(images: list[np.ndarray], main: np.ndarray, prelude: np.ndarray, prelude_bits: np.ndarray):
    """What to write for entropy-coded images of (height, width, 4) samples, with one group of codes each, and before them a number of
    so many bits; `main` says which ones aren't data of transforms. Gives the image, value and bits of all that is to be written."""
    counts, n = np.array([x.shape[0] * x.shape[1] for x in images]), len(images)
    owner = np.arange(n, dtype=np.uint8).repeat(counts)
    red, green, blue, alpha = np.ascontiguousarray(np.concatenate([x.reshape(-1, 4) for x in images]).T)
    flat = alpha.astype(np.uint32) << 24 | red.astype(np.uint32) << 16 | green.astype(np.uint32) << 8 | blue
    starts, lengths, back = references(flat, owner, counts)
    edges = np.zeros(len(flat) + 1, np.int8)
    edges[starts] += 1
    edges[starts + lengths] -= 1
    single = np.cumsum(edges[:-1], dtype=np.int8) == 0
    lone = single.nonzero()[0]
    hashes, mine, pixel = flat * np.uint32(CACHE_FACTOR), owner[lone], flat[lone]
    most, beyond = LITERALS + LENGTHS + (1 << max(CACHES)), LITERALS + LENGTHS

    def tokens(bits: int):
        """The bits of all symbols by entropy, the symbols of pixels outside copies, and which of those are literals."""
        symbols, literal = green[lone].astype(np.int64), np.ones(len(lone), bool)
        if bits:
            key = (hashes >> np.uint32(32 - bits)).astype(np.uint16)
            before = earlier(key, owner)[lone]
            literal = (before < 0) | (flat[before] != pixel)
            symbols = np.where(literal, symbols, key[lone] + np.int64(beyond))
        kinds, at = counted(mine, symbols, n, most), lone[literal]
        others = sum(entropies(counted(owner[at], c[at], n, LITERALS)) for c in (red, blue, alpha))
        return entropies(kinds) + 5 * np.count_nonzero(kinds, 1) + others, symbols, literal

    found = [tokens(b) for b in CACHES]
    best = np.argmin([x[0] for x in found], 0)
    bits = np.array(CACHES)[best]
    symbols = np.choose(best[mine], [x[1] for x in found])
    literal = lone[np.choose(best[mine], [x[2] for x in found])]
    copier = owner[starts]
    code, *more = amounts(lengths)
    named = np.zeros(len(back), np.int64)
    widths = np.array([x.shape[1] for x in images])[copier]
    for width in np.unique(widths):
        short = short_distances(int(width))
        named = np.where((widths == width) & (back < len(short)), short[np.minimum(back, len(short) - 1)], named)
    far, *rest = amounts(np.where(named > 0, named, back + 120))

    values = np.zeros(len(flat), np.int64)  # symbols; -1 inside of copies
    values[:] = -1
    values[lone], values[starts] = symbols, LITERALS + code
    kept = (values >= 0).nonzero()[0]
    # Five codes of each image one after another, in the order of the format.
    wide = np.array([most, LITERALS, LITERALS, LITERALS, DISTANCES])
    first = np.append(0, wide.cumsum()[:-1])
    row = owner.astype(np.int64) * wide.sum()
    places = [row[kept] + values[kept], *(row[literal] + f + c[literal] for f, c in zip(first[1:4], (red, blue, alpha), strict=True)), row[starts] + first[4] + far]
    often = np.bincount(np.concatenate(places), minlength=n * wide.sum())
    used = often.nonzero()[0]
    image, inside = np.divmod(used, wide.sum())
    kind = np.searchsorted(first, inside, "right") - 1
    alphabets = np.tile(wide, (n, 1))
    alphabets[:, 0] = beyond + np.where(bits > 0, 1 << bits, 0)
    which, told, told_bits, codes, sizes = put_codes(image * 5 + kind, inside - first[kind], often[used], alphabets.ravel())
    of, of_bits = np.zeros(len(often), np.int64), np.zeros(len(often), np.int64)
    of[used], of_bits[used] = codes, sizes

    size = np.zeros(len(flat), np.int64)  # of a symbol and what belongs to it: 60 bits at most
    values[kept], size[kept] = of[places[0]], of_bits[places[0]]
    for where, parts in ((literal, [(of[p], of_bits[p]) for p in places[1:4]]), (starts, [more, (of[places[4]], of_bits[places[4]]), rest])):
        value, width = values[where], size[where]
        for v, k in parts:
            value |= v << width
            width += k
        values[where], size[where] = value, width

    flags, flag_bits = np.where(bits > 0, 1 | bits << 1, 0), np.where(bits > 0, 5, 1)
    written = [prelude | flags << prelude_bits, told, values[kept]]
    written_bits = [prelude_bits + flag_bits + main, told_bits, size[kept]]  # no groups of codes in what isn't data of transforms
    order = np.argsort(np.concatenate([np.arange(n) * 8, which // 5 * 8 + which % 5 + 1, owner[kept] * np.int64(8) + 6]).astype(np.uint16), kind="stable")
    whose = np.concatenate([np.arange(n), which // 5, owner[kept]])
    return whose[order], np.concatenate(written)[order], np.concatenate(written_bits)[order]


def packed(owner: np.ndarray, values: np.ndarray, sizes: np.ndarray, count: int) -> list[bytes]:
    """The bytes of each owner's values, lowest bits first."""
    ends = sizes.cumsum()
    last = np.searchsorted(owner, np.arange(count), "right")
    own = np.diff(np.append(0, np.append(0, ends)[last]))
    words = (own >> 6) + 1
    start = words.cumsum() - words
    at = ends - sizes - (own.cumsum() - own)[owner] + (start << 6)[owner]
    values, shift, word = values.astype(np.uint64), (at & 63).astype(np.uint64), at >> 6
    out = np.zeros(words.sum() + 1, "<u8")
    heads = np.append(True, word[1:] != word[:-1]).nonzero()[0]
    out[word[heads]] = np.bitwise_or.reduceat(values << shift, heads)
    over = ((at & 63) + sizes > 64).nonzero()[0]
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    data = out.tobytes()
    return [data[8 * s : 8 * s + (n + 7 >> 3)] for s, n in zip(start.tolist(), own.tolist(), strict=True)]


def with_palette(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The palette, as differences of its neighbours, and the image of indices into it, several to a pixel if they are few."""
    height, width, _ = image.shape
    red, green, blue = np.ascontiguousarray(image.reshape(-1, 3).T).astype(np.int32)
    colours, index = np.unique(red << 16 | green << 8 | blue, return_inverse=True)
    table = np.stack([colours >> 16, colours >> 8 & 255, colours & 255, np.full(len(colours), 255)], 1).astype(np.uint8)
    share = palette_bits(len(colours))
    per = 1 << share
    index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % per)))
    left = np.zeros((height, index.shape[1] // per, 4), np.uint8)
    left[:, :, 1], left[:, :, 3] = (index.reshape(height, -1, per) << ((8 >> share) * np.arange(per))).sum(2), 255
    return np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))[None], left


def predicted_by(tall: np.ndarray, tops: np.ndarray, mode: int) -> np.ndarray:
    """What is left of the samples of images below each other, whose first rows are `tops`, when each pixel is predicted by its left
    (1) or upper (2) neighbour; the edges have modes of their own."""
    out = tall.copy()
    if mode == 1:
        out[:, 1:] -= tall[:, :-1]
        out[1:, 0] -= tall[:-1, 0]
    else:
        out[1:] -= tall[:-1]
        out[tops, 1:] = tall[tops, 1:] - tall[tops, :-1]
    out[tops, 0] = tall[tops, 0]
    return out


def compress_together(images: list[np.ndarray]) -> list[bytes]:
    """What compress_streams gives, of few enough images."""
    heights, width = np.array([len(x) for x in images]), images[0].shape[1]
    tops, tall, n = heights.cumsum() - heights, np.concatenate(images), len(images)
    owner = np.arange(n).repeat(heights * width)
    red, green, blue = tall.reshape(-1, 3).T.astype(np.int64)
    in_order = np.sort(owner << 24 | red << 16 | green << 8 | blue)
    distinct = np.bincount(in_order[np.append(True, in_order[1:] != in_order[:-1])] >> 24, minlength=n)
    few = (1 < distinct) & (distinct <= 256) & (4 * distinct <= heights * width)
    without = tall.copy()
    without[:, :, ::2] -= tall[:, :, 1:2]
    choices = [tall, without, predicted_by(tall, tops, 1), predicted_by(tall, tops, 2)]
    bits = [entropies(counted(owner * 3 + c, x[:, :, c].ravel(), 3 * n, 256)[c::3]) for x in choices for c in range(3)]
    bits = np.array(bits).reshape(4, 3, n).sum(1)
    bits[1:] += 64
    best = bits.argmin(0)
    left = np.stack(choices)[best.repeat(heights), np.arange(len(tall))]

    coded, main, prelude, prelude_bits, whose = [], [], [], [], []

    def add(k, image, is_main, value, size):
        coded.append(image), main.append(is_main), prelude.append(value), prelude_bits.append(size), whose.append(k)

    for k, (top, height) in enumerate(zip(tops.tolist(), heights.tolist(), strict=True)):
        head, size = SIGNATURE | width - 1 << 8 | height - 1 << 22, 40
        image = np.full((height, width, 4), 255, np.uint8)
        image[:, :, :3] = left[top : top + height]
        if few[k]:
            table, image = with_palette(images[k])
            add(k, table, False, head | (1 | PALETTE << 1 | table.shape[1] - 1 << 3) << size, size + 11)
            head = size = 0
        elif best[k] == 1:
            head, size = head | (1 | SUBTRACT_GREEN << 1) << size, size + 3
        elif best[k] > 1:
            image[:, :, 3] = 0
            modes = np.zeros((-(-height >> 9), -(-width >> 9), 4), np.uint8)
            modes[:, :, 1], modes[:, :, 3] = best[k] - 1, 255
            add(k, modes, False, head | (1 | PREDICTOR << 1 | 7 << 3) << size, size + 6)
            head = size = 0
        add(k, image, True, head, size + 1)
    image, values, sizes = put_pixels(coded, np.array(main), np.array(prelude), np.array(prelude_bits))
    return packed(np.array(whose)[image], values, sizes, n)


def compress_streams(images: list[np.ndarray]) -> list[bytes]:
    """VP8L streams of (height, width, 3) samples, all of one width, opaque. An image's stream doesn't depend on the others."""
    out, some, pixels = [], [], 0
    for image in images:
        size = image.shape[0] * image.shape[1]
        if some and (len(some) >= TOGETHER or pixels + size > MOST_PIXELS):
            out += compress_together(some)
            some, pixels = [], 0
        some.append(image)
        pixels += size
    return out + (compress_together(some) if some else [])


def compress_stream(image: np.ndarray) -> bytes:
    return compress_streams([image])[0]


def riff(data: bytes) -> bytes:
    """A WebP file of a stream."""
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + bytes(len(data) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


# Columns of stored media.


def pieces(payload: bytes) -> list[np.ndarray]:
    """The payload, filled up, as images of PIXELS columns; a long one takes several."""
    rows = max(1, -(-len(payload) // BLOCK))
    samples = np.frombuffer(payload.ljust(rows * BLOCK, FILL), np.uint8).reshape(rows, PIXELS, 3)
    return [samples[k : k + MOST_SIDE] for k in range(0, rows, MOST_SIDE)]


def store(payload: bytes, to_stream=encode_stream) -> bytes:
    """The payload as files in a row."""
    return b"".join(riff(to_stream(x)) for x in pieces(payload))


def store_all(payloads: list[bytes]) -> list[bytes]:
    """Every payload as files in a row, of the whole method."""
    images = [pieces(p) for p in payloads]
    streams = iter(compress_streams([x for some in images for x in some]))
    return [b"".join(riff(next(streams)) for _ in some) for some in images]


def load(media: bytes, arrays: bool = True) -> np.ndarray:
    """The pixel array (rows, PIXELS, 3) of stored media."""
    return np.concatenate([x[:, :, :3] for x in decode(media, arrays)])


def load_all(media: list[bytes]) -> list[np.ndarray]:
    """The pixel arrays of many stored media, read symbol by symbol, those of all media side by side."""
    streams = [[data for tag, data in chunks(file) if tag == b"VP8L"] for file in media]
    images = iter(abreast([decoding(data, False) for file in streams for data in file]))
    return [np.concatenate([next(images)[:, :, :3] for _ in file]) for file in streams]


def feature(pixels: np.ndarray) -> str:
    """Shape, mean and deviation of each channel, and the shares of 8 bands of brightness, as text."""
    h, w, c = pixels.shape
    count = np.stack([np.bincount(pixels[:, :, k].ravel(), minlength=256) for k in range(c)])
    value, n = np.arange(256), h * w
    mean = count @ value / n
    deviation = np.sqrt(np.maximum(count @ value**2 / n - mean**2, 0))
    bands = count.sum(0).reshape(8, 32).sum(1) / (n * c)
    show = lambda xs: ",".join(f"{x:.4f}" for x in xs)
    return f"{w}x{h}x{c};mean={show(mean)};std={show(deviation)};bands={show(bands)}"


COLUMNS = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])
DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("payload"))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (WebP bytes) of every row; null texts count as empty."""

    @frugal
    def run(batches):
        for b in in_parts(batches):
            payloads = b.column("payload").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, payloads), pa.int64()), pa.array(store_all(payloads), pa.binary())],
                names=["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, width, height, channels and pixels (bytes, row by row) of every image in a column of WebP bytes.

    Null media give no row; media that can't be decoded give a row with the error and null pixels.
    """

    def one(doc_id, file):
        try:
            return [(doc_id, x.shape[1], x.shape[0], 4, x.tobytes(), None) for x in decode(file)]
        except (ValueError, IndexError, KeyError) as e:
            return [(doc_id, None, None, None, None, str(e))]

    @frugal
    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for b in in_parts(batches, 64):
            files = zip(b.column("doc_id").to_pylist(), b.column("media"), strict=True)
            rows = [r for i, m in files if m.is_valid for r in one(i, m.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "width", "height", "channels", "pixels", "error"])

    return media.select("doc_id", "media").mapInArrow(
        run, "doc_id long, width int, height int, channels int, pixels binary, error string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as lossless WebP, read back from the stored bytes, with digests and features of what was read.

    A null text counts as empty and takes one block of fill. Rows that repeat give repeated results.
    """

    def row(doc_id, payload, media, pixels):
        back = pixels.tobytes()
        return (
            doc_id, len(payload), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
            len(media), hashlib.sha256(media).hexdigest(), feature(pixels),
        )

    @frugal
    def run(batches):
        for b in in_parts(batches, 2048):
            payloads = b.column("payload").to_pylist()
            media = store_all(payloads)
            rows = list(map(row, b.column("doc_id").to_pylist(), payloads, media, load_all(media)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=COLUMNS)

    return texts(docs, id_col, text_col).mapInArrow(run, DDL)
