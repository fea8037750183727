"""Cross-tokenizer alignment against a plain version that encodes whole texts and counts links in dictionaries."""

import functools
import hashlib
from collections import Counter

import numpy as np
import pytest

from ledgerlark.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    None, "", " ", "  x", "x ", "\n", "a b\nc  d", "a b a b a b a", "▁a b", "a ▁b", "日本 é 🎉 ok", "a b c　 d", "<|endoftext|> <s> </s> <0x41>",
    "\x00 a\x00b \x1c c", "ﬁ ½ ² é a​b", "word " * 500, "x" * 2000, "A b a B a b", "a b\nc  d",
]


def plain(texts):
    """Rows as the operator returns them: counts, count_sum, n_best, groups."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    of = alignment._byte_level()

    @functools.cache
    def one(t):
        links, groups, n = [], [], (0, 0)
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in x]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                n = (len(x), len(y))
                ends_a, ends_b = (dict(zip(np.cumsum([len(w) for w in own]).tolist(), ids)) for own, ids in ((bytes_a, x), (bytes_b, y)))
                low = 0
                for end in sorted(ends_a.keys() & ends_b.keys()):
                    links.append((ends_a[end], ends_b[end]))
                    groups.append("|".join(",".join(str(i) for e, i in ends.items() if low < e <= end) for ends in (ends_a, ends_b)))
                    low = end
        return *n, links, ";".join(groups)

    rows = [one(t) for t in texts]
    total = Counter(link for r in rows for link in r[2])
    best = Counter()
    for (_, of_b), k in total.items():
        best[of_b] = max(best[of_b], k)
    return [(n_a, n_b, len(links), len(links), sum(total[k] for k in links), sum(total[k] == best[k[1]] for k in links), groups) for n_a, n_b, links, groups in rows]


@pytest.mark.parametrize(("copies", "entries"), [(1, alignment.ENTRIES), (60, 10)])
def test_equals_plain(spark, copies, entries):
    """In one block for each task, and in one for each slice of texts."""
    ids, texts = [*range(len(ODD) - 3), 3, 3, None] * copies, ODD * copies
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id bigint, text string, N_A string").repartition(2)
    for with_groups in (True, False):
        found = alignment.aligned(docs, A_FILE, B_FILE, docs.columns, with_groups=with_groups, entries=entries)
        assert found.columns == ["doc_id", "text", *alignment.COUNTS, "count_sum", "n_best", "groups_sha256", *(["groups"] if with_groups else [])]
        want = [(i, t, *row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "", *([row[-1]] if with_groups else [])) for i, t, row in zip(ids, texts, plain(texts))]
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id bigint, text string"), A_FILE, B_FILE, ["doc_id"]).count() == 0


def test_words_are_forgotten_within_bounds(monkeypatch):
    texts = [f"w{i} v{i % 7} w{i}" for i in range(300)]
    whole = alignment.Aligner(A_FILE, B_FILE)(texts)
    monkeypatch.setattr(alignment, "MEMORY", 40)
    align = alignment.Aligner(A_FILE, B_FILE)
    parts = [align(texts[i : i + 20]) for i in range(0, 300, 20)]
    assert (np.concatenate([p[0] for p in parts]) == whole[0]).all() and sum((p[1] for p in parts), []) == whole[1]
    assert len(align.code) <= 50


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    owner, doc = np.divmod(np.unique(np.concatenate([rng.integers(0, 40 * alignment.BLOCK, 500), np.arange(alignment.BLOCK), rng.integers(alignment.BLOCK, 3 * alignment.BLOCK, 1500)])), alignment.BLOCK)
    bits = alignment.packed(owner, doc, 41)
    assert sorted(zip(*map(np.ndarray.tolist, alignment.unpacked(bits)))) == sorted(zip(owner.tolist(), doc.tolist()))
    assert alignment.popcounts(bits).tolist() == np.bincount(owner, minlength=41).tolist() and len(bits[0].as_py()) == alignment.BLOCK // 8
    extra = rng.integers(0, 9, len(owner))
    number, planes = alignment.planes_of(extra, owner, doc, 41)
    place, at = alignment.unpacked(planes)
    back = Counter()
    of, power = np.repeat(np.arange(41), number), np.concatenate([np.arange(n) for n in number])
    for p, d in zip(place.tolist(), at.tolist()):
        back[int(of[p]), d] += 1 << int(power[p])
    assert back == Counter({(o, d): e for o, d, e in zip(owner.tolist(), doc.tolist(), extra.tolist()) if e})
