import random

import numpy as np

from quillon.llm import shared


def test_word_hashes_name_words():
    r = random.Random(1)
    gaps = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", "\r\n"]
    seen, names = {}, {}
    for _ in range(300):
        words = [r.choice(["a", "b", "ab", "ba", "é", " ", "\x1c", "x" * r.randrange(1, 50), str(r.random())]) for _ in range(r.randrange(30))]
        text = r.choice(["", *gaps]) + "".join(w + r.choice(gaps) for w in words)
        data = text.encode()
        h = shared.word_hashes(data).tolist()
        assert len(h) == len(data.split())
        for w, x in zip(data.split(), h, strict=True):
            assert seen.setdefault(w, x) == x and names.setdefault(x, w) == w


def thue_morse(n: int, first: str) -> str:
    """The word of ``n`` letters that polynomial hashes modulo a power of two can't tell from its mirror."""
    x, y = ("a", "b") if first == "a" else ("b", "a")
    return "".join(y if bin(k).count("1") % 2 else x for k in range(n))


def test_word_hashes_tell_words_apart():
    words = [thue_morse(1 << k, c).encode() for k in range(1, 13) for c in "ab"]
    one, two = shared.word_hashes(b" ".join(words), 2)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words)
    assert not set(one.tolist()) & set(two.tolist())


def test_word_hashes_of_long_texts(monkeypatch):
    words = [f"w{k % 321}".encode() * (1 + k % 9) for k in range(5000)] + [b"L" * 70_000, b"end", b"M" * 70_000]
    whole = shared.word_hashes(b" ".join(words), 2)
    monkeypatch.setattr(shared, "STRETCH", 1000)
    monkeypatch.setattr(shared.LongWords, "MEMO", 10)
    for text in (b" ".join(words), b"\n" + b"  ".join(words) + b" ", b" ".join(words[::-1])):
        for got, first in zip(shared.word_hashes(text, 2), whole, strict=True):
            assert np.array_equal(got, first if text.split() == words else first[::-1])
    assert len({*whole[0].tolist(), *whole[1].tolist()}) == 2 * len(set(words))


def test_clean_removes_folders(spark, tmp_path):
    from quillon import storage

    df = shared.stored(spark.range(3), "x")
    path = shared.filesystem(df.inputFiles()[0])[1]
    held, storage._FOLDERS[:] = storage._FOLDERS[:-1], storage._FOLDERS[-1:]
    import os

    assert os.path.exists(path)
    shared.clean()
    assert not os.path.exists(path)
    storage._FOLDERS[:] = held


def test_folder_is_below_the_shared_one(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared.shared_dir(spark).startswith(root) and shared.shared_dir(spark) != shared.shared_dir(spark)
