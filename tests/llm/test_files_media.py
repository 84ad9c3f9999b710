import struct
import zlib

import pytest
from helpers_llm import LONG, ODD, empty, odd, saved, text
from pyspark.sql import functions as F

from quillon.llm import media, shared, token_files


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_tokenizer())


def test_encoder_equals_library():
    tk = library()
    texts = ["", " ", "Hello, World!!", "a's 12,5 don't ÉCOLE Straße 日本語 　x\u0085y\x1cz", "<|startoftext|> x<|endoftext|>", "é ́a Å", LONG[:2000], text(3, 50), "A$$$ b### c|d | 'll", "İ ǅ ﬁ"]
    enc = token_files.Encoder(token_files.default_tokenizer())
    for _ in range(2):
        got = enc.encode([t.encode() for t in texts])
        assert [list(struct.unpack(f"<{len(g) // 4}I", g)) for g in got] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def by_hash(spark, docs):
    """(doc_id, text) in the order of the shards: by doc_id, nulls first, then by the hash of the text."""
    df = spark.createDataFrame([(r[0], r[1]) for r in docs], "doc_id long, text string")
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id", F.xxhash64(F.col("text"))).collect()]


def test_files_of_rows_without_ids_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_ROWS", 10)
    docs = spark.createDataFrame([(None, text(k, 20)) for k in range(80)], "doc_id long, text string")
    shards = token_files.write(docs, shared.shared_dir(spark)).collect()
    assert sum(r.n_docs for r in shards) == 80 and len(shards) >= 6 and max(r.n_docs for r in shards) <= 30


def test_files_hold_all_documents(spark, tmp_path):
    tk, folder = library(), shared.shared_dir(spark)
    shards = token_files.write(odd(spark), folder)
    listed = shards.orderBy("shard").collect()
    docs = by_hash(spark, ODD)
    want, start = [], 0
    for r in docs:
        ids = [*tk.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = sorted([tuple(r) for r in token_files.read(shards).collect()], key=lambda r: r[1])
    assert got == want
    # one document, by its frame alone
    shard = token_files.open_shard(listed[-1].uri)
    assert shard.doc_ids()[-1] == 10 and shard.ids(len(shard) - 2)[-1] == 1
    assert token_files.read(token_files.write(empty(spark), shared.shared_dir(spark))).count() == 0
    assert token_files.op3_token_files(spark, saved(odd(spark), tmp_path)).count() == 13


def test_damage_is_noticed(spark):
    shards = token_files.write(odd(spark).filter("doc_id = 5"), shared.shared_dir(spark))
    fs, path = shared.filesystem(shards.first().uri)
    data = bytearray(open(path, "rb").read())
    import io

    frames = token_files.ShardReader(io.BytesIO(bytes(data)), len(data))
    data[int(frames.at[2]) - 2] ^= 1
    with pytest.raises(Exception, match="damaged|frame|decompress|corrupt|Data"):
        token_files.ShardReader(io.BytesIO(bytes(data)), len(data)).frame(1)


def test_zstandard_reads_shards_as_one_stream(spark):
    import io

    import zstandard

    uri = token_files.write(odd(spark).filter("doc_id in (4, 5)"), shared.shared_dir(spark)).orderBy("shard").first().uri
    data = open(shared.filesystem(uri)[1], "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    reader = token_files.open_shard(uri)
    assert plain.startswith(reader.frame(0) + reader.frame(1))


@pytest.mark.parametrize("data", [b"", b"x", b"y" * 192, b"z" * 193, bytes(range(256)) * 9, b"ends with spaces   "])
def test_medium_round_trip(data):
    payload, n = media.from_medium(media.as_medium(data))
    assert n == len(data) and payload[:n] == data and len(payload) % 192 == 0 and payload and set(payload[n:]) <= {32}
    broken = bytearray(media.as_medium(data))
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_medium(bytes(broken))


def test_parse_keeps_order_and_captions():
    page = '<title>no</title><p>one <b>two</b></p><figure><img src="media:d1" alt="old"><img src="http://x/y.png"><figcaption>cap &amp; tion</figcaption></figure>tail<img src="media:d2" alt="alone"><script>x</script><img>'
    items = media.parse(page)
    assert [(i["pos"], i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [(0, "text", "one two", None), (1, "media", "d1", "cap & tion"), (2, "media", None, "cap & tion"), (3, "text", "tail", None), (4, "media", "d2", "alone")]
    assert media.parse(None) == [] and media.parse("") == [] and media.parse("<figure><figcaption>x") == []


def test_parse_heads_and_silent_elements():
    kinds = lambda page: [(i["kind"], i["text"] or i["src"]) for i in media.parse(page)]
    kept = [("text", "kept text"), ("media", "a.png")]
    assert kinds('<html><head><title>t</title><body><p>kept text</p><img src="a.png">') == kept
    assert kinds('<html><head><title>t</title><meta charset="x"><p>kept text</p><img src="a.png">') == kept
    assert kinds('<head><style>s</style></head><p>kept text</p><img src="a.png"><noscript>no<img src="b.png"></noscript>') == kept
    assert kinds('<p>kept text</p><template><title>x</template><img src="a.png">') == kept
    assert kinds('<script src="x"/><p>kept text</p></noscript><img src="a.png"/>') == kept


def test_sequences_of_the_given_pages(spark):
    """Every page: the text of its items is what stands outside tags and silent elements, in order; media keep their places."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    source = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r["items"] for r in media.sequences(pages).collect()}
    assert got.keys() == source.keys() and sum(map(len, got.values())) > 1000
    for k, page in source.items():
        shown = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template|head|title)\b.*?</\1\s*>|<figcaption.*?</figcaption>|<[^>]*>", " ", page)
        want = "".join(html.unescape(shown).split())
        assert "".join("".join((i.text or "").split()) for i in got[k]) == want
        assert [i.pos for i in got[k]] == list(range(len(got[k])))
        assert [i.src for i in got[k] if i.kind == "media"] == [html.unescape(m) for m in re.findall(r'(?is)<(?:img|video|audio|source|embed)\b[^>]*?\ssrc="([^"]+)"', re.sub(r"(?is)<(script|noscript|template|head)\b.*?</\1\s*>", " ", page))]


def test_sequences_resolve_by_digest(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="media:k"><img src="media:gone">', 5), (2, None, 6), (3, '<img src="media:k" alt="c">', 7), (3, '<img src="media:k" alt="c">', 7)], "page_id long, html string, items int")
    known = spark.createDataFrame([("k", 9)], "digest string, size int")
    got = media.resolve(media.sequences(pages), known).select("page_id", "pos", "digest", "caption", "size").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1, "k", None, 9), (1, 2, "gone", None, None), (3, 0, "k", "c", 9), (3, 0, "k", "c", 9)], key=repr)


def test_resolve_replaces_columns_of_its_names(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="media:k" alt="c">', 5, "x", "y", 3, "z", "w")], "page_id long, html string, Pos int, digest string, caption string, SIZE int, item string, page string")
    known = spark.createDataFrame([("k", 9)], "digest string, size int")
    got = media.resolve(media.sequences(pages), known)
    assert got.columns == ["digest", "page_id", "item", "page", "pos", "caption", "size"]
    assert [tuple(r) for r in got.collect()] == [("k", 1, "z", "w", 1, "c", 9)]


def test_media_query(spark, tmp_path):
    import hashlib

    got = media.op6_media(spark, saved(odd(spark), tmp_path)).collect()
    assert len(got) == 13
    texts = {(r[0], len((r[1] or "").encode())): (r[1] or "").encode() for r in ODD}
    for r in got:
        data = texts[r.doc_id, r.n_bytes]
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.feature == media.feature(payload) and r.media_sha256 == hashlib.sha256(media.as_medium(data)).hexdigest() and r.pos == 1
    assert media.op6_media(spark, saved(empty(spark), tmp_path)).count() == 0
