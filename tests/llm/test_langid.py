"""The network's gradients, and its accuracy on held-out text."""

import zlib

import numpy as np

from rootstone.llm import langid

WORDS = {"aa": "the of and with from there is house water", "bb": "der und nicht mit über größe ist wasser häuser", "cc": "él la que año señor está por agua casas"}


def corpus(n=240):
    draw = np.random.default_rng(1)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(draw.choice(WORDS[lang].split(), int(draw.integers(3, 120)))), lang))
    return rows


SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string, source string"


def test_held_out_accuracy(frame):
    rows = corpus() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? ²", "bb"), (1003, "the house", None), (1004, "Å" * 70_000, None), (None, "der und nicht", "bb")]
    df = frame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    network = langid.fit(df)
    found = langid.identify(df, network, ["doc_id"]).collect()
    assert network.langs == ["aa", "bb", "cc"] and len(found) == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    test = [(i, lang) for i, _, lang in corpus() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 40 and np.mean([got[i][0] == lang for i, lang in test]) >= 0.95
    assert [got[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003][0] == "aa" and got[None][0] == "bb" and got[1004][0] in network.langs
    assert all(0 <= s <= 1 for _, s in got.values())
    again = langid.fit(df.repartition(5))
    assert all(np.array_equal(getattr(network, n), getattr(again, n)) for n in ("embed", "filters", "bias", "out"))


def test_learns_nothing_held_out(frame):
    rows = [(i, t, lang) for i, t, lang in corpus() if zlib.crc32(str(i).encode()) % 4 == 2]
    df = frame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    assert langid.fit(df) is None and langid.fit(frame([], SCHEMA)) is None
    assert {(r.lang_pred, r.score) for r in langid.identify(df, None, ["doc_id"]).collect()} == {("und", 0.0)}


def test_windows_cover_the_text():
    text = bytes(range(1, 200)) * 3
    assert b"".join(w.tobytes() for w in langid.windows(text)).rstrip(b"\0") == text and len(langid.windows(b"")) == 1


def test_convolution_is_the_definition():
    net = langid.Network(["a", "b"])
    x = np.random.default_rng(3).integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    a, _ = net.pooled(x)
    filters = net.filters.reshape(max(langid.WIDTHS), langid.EMBED, -1)
    padded = np.pad(x, ((0, 0), (0, max(langid.WIDTHS) - 1)))
    for n, place in ((0, 0), (2, 57), (3, langid.WINDOW - 1)):
        want = sum(net.embed[padded[n, place + j]] @ filters[j] for j in range(max(langid.WIDTHS)))
        assert np.allclose(a[n, place], want, atol=1e-4)
    assert np.allclose(np.exp(net.logits(x)).sum(axis=1), 1, atol=1e-5)


def test_training_lowers_the_loss():
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.integers(60, 90, (200, langid.WINDOW)), draw.integers(80, 110, (200, langid.WINDOW))]).astype(np.uint8)
    y = np.repeat([0, 1], 200)
    net = langid.Network(["a", "b"])
    loss = lambda: -net.logits(x)[np.arange(400), y].mean()
    before = loss()
    net.train(x, y)
    assert loss() < 0.1 < before


def test_a_prediction_is_the_definition(frame):
    """Whole texts, by loops over the definition."""
    rows = [r for r in corpus(60)] + [(70, "der " * 400, None), (71, "é", None)]
    df = frame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    net = langid.fit(df)
    k, f = max(langid.WIDTHS), langid.FILTERS
    for r in langid.identify(df.where("doc_id > 55"), net, ["doc_id", "text"]).collect():
        raw, logs = r.text.encode(), []
        for at in range(0, len(raw), langid.WINDOW):
            window = raw[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0") + bytes(k - 1)
            pooled = []
            for j in range(f * len(langid.WIDTHS)):
                width, filters = langid.WIDTHS[j // f], net.filters.reshape(k, langid.EMBED, -1)
                sums = [sum(float(net.embed[window[p + i]] @ filters[i, :, j]) for i in range(width)) for p in range(langid.WINDOW)]
                pooled.append(max(max(sums) + net.bias[j], 0))
            z = np.array(pooled) @ net.out + net.out_bias
            logs.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
        mean = np.mean(logs, axis=0)
        shares = np.exp(mean) / np.exp(mean).sum()
        assert r.lang_pred == net.langs[int(mean.argmax())] and abs(r.score - shares.max()) < 1e-3
        assert abs(np.log(r.lead) - (np.sort(mean)[-1] - np.sort(mean)[-2])) < 1e-2


def test_every_labelled_language_is_learnt(frame):
    df = frame([(i, f"wort{i % 230} " * 3, f"l{i % 230:03}", "x", "y", "z") for i in range(920)], SCHEMA)
    assert len(langid.fit(df).langs) == 230
