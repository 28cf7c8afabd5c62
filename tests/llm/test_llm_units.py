"""The operators' local parts against libraries and brute force."""

import random
import zipfile

import numpy as np
import public_tokenizers as P
import pytest

from risklens.llm import chat_tree, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, zip_warc
from risklens.llm.pieces import PieceCodec
from risklens.llm.shingles import overlap, shingle_set
from risklens.llm.token_counts import TokenCounter

R = random.Random(5)
ODD = ["", " ", "  a  ", "</s><s><0x0A>", "\x00\x1c\x85", "a" * 5000, "日本 😀 ềx", "▁▁a▁", "\n\n\t", "don't I'M", "<|endoftext|>a<|endoftext|>", " " * 300 + "x" * 301]
ODD += ["".join(R.choice("aeê▁ \n\t'd1é日😀<s>.\u3000\x1c\x85½\u200b") for _ in range(R.randint(1, 40))) for _ in range(400)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_pieces_equal_the_library():
    import sentencepiece
    path = P.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceCodec(open(path, "rb").read())
    for t in ODD:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == ids and own.decode(ids) == sp.decode(ids) == own.encode_both(t)[1]


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), TokenCounter(open(path, "rb").read())
    assert [own.count(t) for t in ODD] == [len(tok.encode(t, add_special_tokens=False).ids) for t in ODD]


def test_network_gradients():
    net = language_id.ByteNet.fresh(["a", "b"], 3, 1)
    for d in (net.forward, net.backward):
        d.table, d.recur = d.table.astype(float), d.recur.astype(float)
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    x, y = np.random.default_rng(0).integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = net.gradients(x, y)
    for w, g in zip(net.weights(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, sides = w[i], []
        for step in (1e-4, -1e-4):
            w[i] = old + step
            sides.append(net.gradients(x, y)[0])
        w[i] = old
        assert g[i] == pytest.approx((sides[0] - sides[1]) / 2e-4, rel=1e-3, abs=1e-7)


def test_perfect_hash_is_minimal_and_checked():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**63, (3000, 4)).astype("<u8")
    levels, slot = exact_dedup.build_levels(words)
    assert sorted(slot) == list(range(3000))
    assert (exact_dedup.find_slots(words, levels) == slot).all()
    assert (exact_dedup.find_slots(words[:0], []) == np.empty(0)).all()


def test_turns_are_reversible():
    for role in ("user", "assistant", "a\nb\\", "", "<|im_start|>"):
        for text in [*ODD, *chat_tree.CONTROL, "\\", "\\<|im_end|>\n", "</s>[INST] ok [/INST]"]:
            rendered, lo, hi = chat_tree.render(role, text)
            assert chat_tree.parse(rendered) == (role, text)
            assert chat_tree.unescape(rendered[lo:hi]) == (text if role == "assistant" else "")
            assert not any(c in chat_tree.escape(text) for c in chat_tree.CONTROL)


def test_edit_automaton_and_keys():
    for _ in range(3000):
        a = "".join(R.choice("abc") for _ in range(R.randint(0, 14)))
        b = list(a)
        for _ in range(R.randint(0, 4)):
            k = R.randint(0, len(b))
            b[k:k + R.randint(0, 1)] = R.choice(["", "a", "d"])
        b = "".join(b)
        d = edit_distance(a, b)
        for e in (1, 2, 3):
            assert line_dedup.within(a, b, e) == min(d, e + 1)
            if d <= e and min(len(a), len(b)) > e:
                assert set(line_dedup.line_keys(a, e).tolist()) & set(line_dedup.line_keys(b, e).tolist())


@pytest.mark.parametrize("percent, part", [(80, None), (80, 0.0), (80, 0.3), (80, 0.6), (80, 1.0), (85, None), (95, None)])
def test_linked_sets_share_a_class(percent, part):
    """``part``: how many of all shingles are common."""
    rng = np.random.default_rng(3)
    signer = jaccard_join.Signer(percent, None if part is None else rng.random(jaccard_join.CELLS) < part)
    for n in [1, 2, 5, 6, 7, 9, 12, 15, 20, 27, 33, 50, 120, 700, 5000]:
        for _ in range(12):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = x.copy()
            while True:  # as many changes as a link allows
                z = y[1:] if rng.random() < 0.5 and len(y) > 1 else np.unique(np.append(y, rng.integers(0, 2**63, 1).astype(np.uint64)))
                c = overlap(x, z)
                if 100 * c < percent * (len(x) + len(z) - c):
                    break
                y = z
            assert set(signer.signatures(x).tolist()) & set(signer.signatures(y).tolist())


def test_thresholds_that_classes_cannot_serve():
    for percent in (0, 79, 101):
        with pytest.raises(ValueError):
            jaccard_join.Signer(percent)


def test_shingle_sets():
    assert len(shingle_set(None, 4)) == len(shingle_set(" \n", 4)) == 0
    assert len(shingle_set("a b", 4)) == 1 and len(shingle_set("a b c d e", 4)) == 2
    assert (shingle_set("A b\tC\x0bd", 4) == shingle_set("a B c d", 4)).all()
    assert not overlap(shingle_set("a b c", 4), shingle_set("a b c d", 4))


def test_alignment_is_smith_waterman():
    for _ in range(60):
        item, text = [np.array([R.randint(0, 4) for _ in range(R.randint(1, 12))], np.uint64) for _ in range(2)]
        table, best = np.zeros((len(item) + 1, len(text) + 1), int), 0
        for i in range(1, len(item) + 1):
            for j in range(1, len(text) + 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (2 if item[i - 1] == text[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
                best = max(best, table[i, j])
        padded = np.concatenate([text, np.full(3, item[0], np.uint64)])[None]
        assert decontaminate.align(item, padded, np.array([len(text)]))[0][0] == best


def test_package_is_a_zip(tmp_path):
    path = tmp_path / "x.zip"
    with open(path, "wb") as f:
        p = zip_warc.Packager(f)
        for name, raw in (("a", b"one"), ("b/c", b""), ("d", b"x" * 70000)):
            p.open(name)
            p.write(raw)
            p.close_member()
        p.finish()
    with zipfile.ZipFile(path) as z, open(path, "rb") as f:
        assert z.testzip() is None and z.read("d") == b"x" * 70000
        found = zip_warc.directory(f, path.stat().st_size)
        assert {k: zip_warc._read(f, *v) for k, v in found.items()} == {n: z.read(n) for n in z.namelist()}
    with zipfile.ZipFile(tmp_path / "plain.zip", "w") as z:  # another writer's, without ZIP64 and with a packed member
        z.writestr("k", b"abc")
        z.writestr("packed", b"q" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"note"
    with open(tmp_path / "plain.zip", "rb") as f:
        got = zip_warc.directory(f, (tmp_path / "plain.zip").stat().st_size)
        assert list(got) == ["k"] and zip_warc._read(f, *got["k"]) == b"abc"


def test_records_come_back():
    raw = zip_warc.record(5, "http://x/\r\ny", "é\r\n\r\n".encode(), None)
    assert zip_warc.parse_record(raw)[:2] == (5, 6)
    assert zip_warc.parse_record(zip_warc.record(7, None, b"", 5))[3:] == ("revisit", 5)


def test_filters_lose_no_alignment():
    """Against whole alignments: few words, so that bounds are met closely; stretches are cut."""
    for stretch, letters in ((1024, 4), (8, 5), (8, 12)):
        decontaminate.STRETCH, before = stretch, decontaminate.STRETCH
        try:
            for _ in range(40):
                items = [" ".join(f"w{R.randint(0, letters)}" for _ in range(R.randint(1, 12))) for _ in range(4)]
                block = decontaminate.TestItems(list(enumerate(items)))
                texts = []
                for _ in range(6):
                    words = [w for w in R.choice(items).split() for w in ([w], [], [w, "x"], ["y"], [w], [w])[R.randint(0, 5)]]
                    texts.append(" ".join([f"w{R.randint(0, letters + 20)}" for _ in range(R.randint(0, 30))] + words + [f"w{R.randint(0, letters + 20)}" for _ in range(R.randint(0, 30))]))
                for t, got in zip(texts, block.matches(texts, decontaminate.THRESHOLD)):
                    own = decontaminate.words_of(t)
                    want = {}
                    for k, item in enumerate(block.words):
                        s = decontaminate.align(item, own[None], np.array([len(own)]))[0][0] / (2 * len(item)) if len(own) else 0
                        if s >= decontaminate.THRESHOLD:
                            want[k] = s
                    assert {k: s for k, s, _, _ in got} == want
                    for k, s, a, b in got:
                        assert decontaminate.align(block.words[k], own[None, a:b], np.array([b - a]))[0][0] == pytest.approx(s * 2 * len(block.words[k]))
        finally:
            decontaminate.STRETCH = before


def test_short_items_unspaced_scripts_and_dense_edits():
    items = ["lonely row", "東京は日本の首都です", " ".join(f"a{k}" for k in range(30))]
    texts = ["here a lonely row stands inside", "昨日、東京は日本の首都でした。そうですか",
             "so " + " ".join("x" if k % 3 == 2 else f"a{k}" for k in range(30)) + " on", "大阪に行きました", "none of them"]
    got = decontaminate.TestItems(list(enumerate(items))).matches(texts, decontaminate.THRESHOLD)
    assert [[m[0] for m in ms] for ms in got] == [[0], [1], [2], [], []]
    assert got[0][0][1:] == (1.0, 2, 4) and got[2][0][1] >= 0.5


def test_short_lines_share_a_key():
    for _ in range(4000):
        a = "".join(R.choice("ab ") for _ in range(R.randint(10, 29)))
        b = list(a)
        for _ in range(R.randint(0, 2)):
            k = R.randint(0, len(b))
            b[k:k + R.randint(0, 1)] = R.choice(["", "a", "d"])
        b = "".join(b)
        e = 2 if min(len(a), len(b)) >= 24 else 1 if min(len(a), len(b)) >= 12 else 0
        assert line_dedup.near(a, b, 2, 24) == (edit_distance(a, b) <= e)
        if e and edit_distance(a, b) <= e:
            assert set(line_dedup.keys_of_all(a, 2, 24).tolist()) & set(line_dedup.keys_of_all(b, 2, 24).tolist())
    assert line_dedup.near("Share this page", "Share this page!", 2, 24)


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_sketches_pass_every_link(percent):
    """Pairs that link pass the test of sketches; unrelated large sets don't."""
    rng, may, distance = np.random.default_rng(percent), jaccard_join.may_link(percent), jaccard_join.jaccard_distance(percent)
    for _ in range(600):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400))).astype(np.uint64))
        gone, new = rng.integers(0, len(a) // 6 + 1), rng.integers(0, len(a) // 6 + 1)
        b = np.unique(np.r_[a[gone:], rng.integers(0, 1 << 63, int(new)).astype(np.uint64)])
        x, y = jaccard_join.sketch(a), jaccard_join.sketch(b)
        assert may(x, y) == may(y, x)
        assert may(x, y) or not distance(a.tobytes(), b.tobytes())[0]
    x, y = (jaccard_join.sketch(np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))) for _ in range(2))
    assert not may(x, y) and len(x) <= 8 + 300 / 4


def test_codec_rests_between_tasks():
    """Nothing but packed pairs is held between tasks, and ids and texts stay the library's."""
    import public_tokenizers
    import sentencepiece
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=model), PieceCodec(model)
    texts = ["", "a plain text, plain text", "▁a b", "a  b\x00c\ud7ff", "🙂 x 🙂 plain", "日本語 text", "▁", "tab\tx\n" + "y" * 60]
    for _ in range(2):
        own.wake()
        for t in texts * 2:
            ids, text = own.encode_both(t)
            want = [own.begin, *lib.encode(t), own.end]
            assert np.frombuffer(ids, "<u4").tolist() == want and text == lib.decode(want)
        pairs = dict(own.pairs)
        own.rest()
        assert not own.memo and not own.odd and not own.pairs and len(own.packed[0]) == len(pairs) > 0
    own.wake()
    assert own.pairs == pairs


def test_windows_come_block_by_block():
    """The same blocks as of all windows at once, but no more than a block and a text are held."""
    texts = [b"x" * n for n in (0, 1, 64, 65, 64 * language_id.LANES * 2 + 5, 7, 64 * language_id.LANES - 64, 3)]
    blocks = list(language_id.window_blocks(texts))
    assert [len(w) for w, _ in blocks[:-1]] == [language_id.LANES] * (len(blocks) - 1)
    owner = np.concatenate([o for _, o in blocks])
    assert owner.tolist() == [d for d, t in enumerate(texts) for _ in range(-(-len(t) // 64))]
    held = np.bincount(owner, (np.concatenate([w for w, _ in blocks]) > 0).sum(axis=1), len(texts))
    assert held.tolist() == [len(t) for t in texts]


def test_arrow_gives_memory_back_at_a_tasks_end(monkeypatch):
    from risklens.llm import common
    calls = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(1)})())
    run = common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(run) == 2 and not calls
    assert list(run) == [3] and calls == [1]
