import hashlib
import random
import struct
import tracemalloc
import zlib

import pytest
from tokenizers import Tokenizer

from quernlight.llm import queries as q
from quernlight.llm.bpe import PrefixBPE, bpe_encode
from quernlight.llm.media import UNIT, _box, _full, media_columns, media_digests, pack, pad, parse, samples, store_texts
from quernlight.llm.token_counts import WORD_MARK, LongestMatch, count_tokens, load_pieces

ROWS = [(1, "", "x"), (None, None, "x"), (2, "Hello  wörld's end", None), (2, "Hello  wörld's end", None), (3, "long " * 30000, "y"),
        (4, "<|endoftext|>a\x1cb'll LLLL ΣΑΣ", "z"), (5, "l" * 3000, "z")]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_bpe_equals_library(spark, docs, sf_dir):
    tok = Tokenizer.from_file(q.tokenizer_path("word_bpe_49k.json"))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [r[1] or "" for r in ROWS]
    rnd = random.Random(5)
    texts += ["".join(rnd.choice("aallbcé'’ſİΣ漢🙂 \t\n1²!<|endoftext|>́") for _ in range(50)) for _ in range(500)]
    with open(q.tokenizer_path("word_bpe_49k.json")) as f:
        model = PrefixBPE(f.read())
    for text, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        words = model.encode(text)
        assert [int(i) for w in words for i in w[1].split()] == want.ids and sum(w[0] for w in words) == len(want.ids)
        assert " ".join(w[2] for w in words) == tok.decode(want.ids, skip_special_tokens=False)


def test_words_fall_out_of_memory(monkeypatch):
    with open(q.tokenizer_path("word_bpe_49k.json")) as f:
        source = f.read()
    text = " ".join(f"word{k % 37}x{k % 11}" for k in range(2000))
    whole = PrefixBPE(source).encode(text)
    monkeypatch.setattr("quernlight.llm.bpe.WORD_MEMORY", 5)
    model = PrefixBPE(source)
    assert model.encode(text) == whole and len(model.lately) <= 5 >= len(model.before)


def test_bpe_rows(spark, docs):
    out = bpe_encode(docs, q.tokenizer_path("word_bpe_49k.json"), emit=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(out) == len(ROWS)
    empty = [r for r in out if r.doc_id in (1, None)]
    assert all(r.ids == [] and r.n_tokens == 0 and r.ids_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)
    assert all(len(r.ids) == r.n_tokens and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in out)
    assert bpe_encode(docs.limit(0), q.tokenizer_path("word_bpe_49k.json")).collect() == []


def naive(pieces, word):
    at = n = 0
    while at < len(word):
        for k in range(len(word), at, -1):
            if word[at:k] in pieces:
                n, at = n + 1, k
                break
        else:
            n, at = n + len(word[at].encode()), at + 1
    return n


def test_token_counts_equal_brute_force(spark, docs):
    rnd = random.Random(3)
    for _ in range(300):
        pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 6))}
        automaton = LongestMatch(pieces)
        for _ in range(10):
            word = "".join(rnd.choice("abcd漢") for _ in range(rnd.randint(0, 9)))
            assert automaton.count(word) == automaton.plain(word) == naive(pieces, word)
    pieces = load_pieces(q.tokenizer_path("piece_bpe_32k.model"))
    whole = set(pieces)
    for r in count_tokens(docs, pieces).join(docs.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id != 5:
            assert r.n_tokens == sum(naive(whole, WORD_MARK + w) for w in r.text.split())
    assert count_tokens(docs, pieces).count() == len(ROWS)


def test_media_round_trip():
    for n in (0, 1, 191, 192, 193, 192 * 16, 192 * 16 + 1, 100_000):
        payload = pad(bytes(i % 251 for i in range(n)))
        assert len(payload) % UNIT == 0 and len(payload) >= max(n, UNIT)
        media = pack(payload)
        (track,) = parse(media)
        keys = track.keyframes()
        assert samples(media, track) == payload
        assert (track.codec, track.duration, len(track.sizes)) == ("raw ", len(payload), len(payload) // UNIT)
        assert len(keys) == -(-len(track.sizes) // 8)
        assert media[keys[-1][0] :][:UNIT] == payload[(len(keys) - 1) * 8 * UNIT :][:UNIT]
        for stop in range(0, len(media) - 1, 7 if n < 1000 else 9973):
            assert parse(media[:stop]) is None  # truncated
    assert parse(b"not a container") is None and parse(None) is None and parse(b"") is None


def track(number, sizes, chunks, stss=None, stsz=None, codec=b"avc1", scale=1000, mdhd=40, per=None):
    """A trak box: chunks are (offset, samples in it)."""
    table = [
        _full(b"stsd", struct.pack(">I", 1), _box(codec, bytes(8))),
        _full(b"stts", struct.pack(">III", 1, len(sizes), 10) if sizes else struct.pack(">I", 0)),
        _full(b"stsc", struct.pack(">I", len(chunks)), *(struct.pack(">III", k + 1, n, 1) for k, (_, n) in enumerate(chunks))),
        stsz or _full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)),
        _full(b"stco", struct.pack(">I", len(chunks)), *(struct.pack(">I", at) for at, _ in chunks)),
    ]
    table += [_full(b"stss", struct.pack(f">I{len(stss)}I", len(stss), *stss))] if stss is not None else []
    head = _full(b"tkhd", bytes(8), struct.pack(">I", number), bytes(68))
    times = _full(b"mdhd", bytes(8), struct.pack(">IIHH", scale, mdhd, 0, 0))
    return _box(b"trak", head, _box(b"mdia", times, _box(b"minf", _box(b"stbl", *table))))


def test_two_tracks_and_compact_sizes():
    body = _box(b"mdat", bytes(range(100)))
    four = _full(b"stz2", bytes(3), b"\4", struct.pack(">I", 3), bytes([0x51, 0x70]))  # 5, 1, 7
    moov = _box(b"moov", track(1, [4, 6, 10], [(8, 2), (30, 1)], stss=[1, 3]), track(7, [5, 1, 7], [(50, 3)], stsz=four, codec=b"mp4a"))
    one, two = parse(body + moov)
    assert (one.track_id, one.codec, one.keyframes()) == (1, "avc1", [(8, 4), (30, 10)])
    assert (two.track_id, two.codec, two.keyframes()) == (7, "mp4a", [(50, 5), (55, 1), (56, 7)])
    assert samples(body + moov, one) == bytes([*range(10), *range(22, 32)])


def test_fragments():
    trex = lambda n, size, flags: _full(b"trex", struct.pack(">5I", n, 1, 20, size, flags))
    moov = _box(b"moov", track(1, [], [], mdhd=0), track(2, [], [], codec=b"mp4a", mdhd=0), _box(b"mvex", trex(1, 0, 0x10000), trex(2, 3, 0)))
    data, want = moov, {1: [], 2: []}
    for k in range(2):
        def moof(offset):
            video = _box(b"traf", _full(b"tfhd", struct.pack(">I", 1), flags=0x20000), _full(b"trun", struct.pack(">IiI2I", 2, offset, 0, 11, 4), flags=0x1 | 0x4 | 0x200))
            audio = _box(b"traf", _full(b"tfhd", struct.pack(">II", 2, 7), flags=0x20000 | 0x8), _full(b"trun", struct.pack(">Ii", 4, offset + 15), flags=0x1))
            return _box(b"moof", _full(b"mfhd", struct.pack(">I", k + 1)), video, audio)

        at = len(data)
        size = len(moof(0))
        data += moof(size + 8) + _box(b"mdat", bytes(27))
        want[1].append((at + size + 8, 11))
        want[2] += [(at + size + 8 + 15 + 3 * i, 3) for i in range(4)]
    video, audio = parse(data)
    assert video.keyframes() == want[1] and len(video.sizes) == 4 and video.duration == 80
    assert audio.keyframes() == want[2] and audio.duration == 56


def test_hostile_media(spark):
    """Nested, forged and overlapping: no features, no error, no memory."""
    deep = b""
    for _ in range(3000):
        deep = _box(b"moov", deep)
    body = _box(b"mdat", bytes(range(100)))
    forged = lambda sizes, chunks, n: body + _box(b"moov", track(1, sizes, chunks, stsz=_full(b"stsz", struct.pack(">II", 1, n))))
    run = _full(b"trun", struct.pack(">I", 4_000_000_000))
    moof = _box(b"moof", _box(b"traf", _full(b"tfhd", struct.pack(">I", 1)), run))
    hostile = [
        deep, forged([0] * 3, [(8, 4_000_000_000)], 20_000_000), forged([0] * 3, [(8, 4_000_000_000)], 4),
        body + _box(b"moov", track(1, [200_000], [(8, 1)])), body + _box(b"moov", track(1, [90] * 50, [(8, 1)] * 50)),
        body + _box(b"moov", track(1, [], [])) + moof, body + _box(b"moov", track(1, [1], [(4_000_000_000, 1)])),
    ]
    tracemalloc.start()
    assert [parse(m) for m in hostile] == [None] * len(hostile)
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
    rows = spark.createDataFrame([(k, bytearray(m)) for k, m in enumerate(hostile)], "doc_id long, media binary")
    assert all(r.tracks is None for r in media_columns(rows, "doc_id", "media").collect())
    assert all(r.feature is None and r.media_bytes is None for r in media_digests(rows, "doc_id", "media").collect())


def test_media_query(spark, sf_dir, docs):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = q.op9_media_columns(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = pad(data)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    out = {r.doc_id: r for r in media_columns(store_texts(docs), "doc_id", "media").collect()}
    assert out[1].tracks[0].n_samples == 1 and out[None].tracks[0].codec == "raw " and out[3].tracks[0].n_samples == -(-150000 // UNIT)
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"xx"))], "doc_id long, media binary")
    assert all(r.tracks is None for r in media_columns(odd, "doc_id", "media").collect())
