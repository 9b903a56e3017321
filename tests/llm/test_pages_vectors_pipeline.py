"""Pages, embeddings, components and the pipeline, against brute force."""

import collections
import math
import re

import numpy as np
import pytest

from tessella.llm import cap_filters, components, main_text, runs


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}<script>var a='</p><article>x</article>';</script></head><body>{body}</body></html>"


MENU = "<nav><ul><li><a href='/'>Home</a><li>News</ul></nav><header>Site name</header>"
FOOT = "<footer>&copy; 2020</footer>"


def text_of(html):
    return main_text.extract([main_text.blocks(html)])[0]


def test_article_text():
    html = page(
        MENU + "<div class='ad banner'>Buy <b>now</b></div><article><h1>Head&amp;line</h1><p>One <b>two<br>three <p>A\n\t b&nbsp;&eacute;<!-- no -->"
        "<form>Mail <input></form><section id='comments'><p>First!</p></section><aside>side</aside><style>p{}</style></article>" + FOOT
    )
    assert text_of(html) == "Head&line One two three A b é"
    assert text_of("") == "" and text_of("<p>") == "" and text_of("plain &lt;text&gt;") == "plain <text>"
    assert text_of("<p>open <b>tags <i>only") == "open tags only"
    assert text_of(page("<div role='navigation'>menu</div><main><p>kept</p><div class='cookie-notice'>ok?</div></main><div class='sidebar'>s</div>")) == "kept"
    assert text_of(page("<div class='post-content'><p>body</p></div><p>around</p>")) == "body"
    assert text_of("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a b c d"


def test_host_repeats_go_from_undecided_blocks_only():
    notice = "this site is made with care by a small team of people"
    pages = [main_text.blocks(f"<div>{notice}</div><p>{i} unique words number {i} of this very page</p>") for i in range(4)]
    got = main_text.extract(pages)
    assert all("care" not in t and f"{i} unique words number {i} of" in t for i, t in enumerate(got))
    alone = main_text.extract(pages[:1])[0]
    assert alone.startswith("this site")  # one page repeats nothing
    quoted = [main_text.blocks(f"<article><p>{notice}</p><p>{i}</p></article>") for i in range(4)]
    assert all(notice in t for t in main_text.extract(quoted))


def test_main_texts_frame(spark, monkeypatch):
    monkeypatch.setattr(main_text, "PAGES", 5)
    rows = [(i, f"http://h{i % 2}.org/{i}", page(MENU + f"<article><p>text {i}</p></article>" + FOOT)) for i in range(23)]
    rows += [(50, None, None), (51, "http://h0.org/", ""), (52, "", "<p>lone</p>"), (52, "", "<p>lone</p>"), (None, "x", "<article>" + "long " * 90000)]
    got = main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    assert all(by[i][0].text == f"text {i}" for i in range(23))
    assert by[50][0].text == by[51][0].text == "" and [r.text for r in by[52]] == ["lone", "lone"] and by[None][0].n_chars == 449999
    assert main_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_host_repeats_need_no_common_stream(spark, monkeypatch):
    run = " ".join(f"rare{k}" for k in range(9))
    notice = "this site is made with care by a small team of people"
    rows = [(i, "http://one.org/p", f"<div>{notice}</div><p>{' '.join(f'own{i}x{k}' for k in range(12))}</p>" + (f"<p>{run}</p>" if i in (3, 398) else "")) for i in range(401)]
    rows += [(900, "http://other.org/", f"<p>{notice} {run}</p>")]
    texts = [main_text.blocks(h) for _, _, h in rows[:401]]
    want = dict(enumerate(" ".join(f"own{i}x{k}" for k in range(12)) for i in range(401))) | {900: f"{notice} {run}"}
    assert dict(enumerate(main_text.extract(texts))) == {i: t for i, t in want.items() if i < 900}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for pages, parts in ((400, 1), (7, 5)):
        monkeypatch.setattr(main_text, "PAGES", pages)
        assert {r.page_id: r.text for r in main_text.main_texts(df.repartition(parts)).collect()} == want


def test_site_blocks_go_from_articles_too(spark):
    notice = "sign up for the weekly letter of this site and miss nothing"
    quote = "a sentence that three of the articles quote from one another word by word"
    own = {i: " ".join(f"own{i}x{k}" for k in range(20)) for i in range(24)}
    rows = [(i, "http://one.org/", f"<article><p>{own[i]}</p><div class='letterbox'>{notice}</div>{f'<p>{quote}</p>' if i < 3 else ''}</article>") for i in range(24)]
    copies = [(100 + i, "http://copies.org/", f"<article><p>{quote} {notice}</p><p>{own[0]}</p><p>copy {i}</p></article>") for i in range(24)]
    lines = [(200 + i, "http://few.org/", f"<article><p>{own[i]}</p><p>{notice}</p></article>") for i in range(4)]
    df = spark.createDataFrame(rows + copies + lines, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.main_texts(df.repartition(5)).collect()}
    assert all(got[i] == (f"{own[i]} {quote}" if i < 3 else own[i]) for i in range(24))
    assert all(got[100 + i] == f"{quote} {notice} {own[0]} copy {i}" for i in range(24))
    assert all(got[200 + i] == f"{own[i]} {notice}" for i in range(4))


def test_covered():
    v = np.random.default_rng(0).random(200) < 0.02
    want = [any(v[max(0, i - 4) : i + 1]) for i in range(200)]
    assert runs.covered(np.flatnonzero(v), 5, 200).tolist() == want


def near_vectors(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for i in range(150):
        v = base[i % 5] + rng.normal(size=dim) * rng.choice([0.02, 0.08, 0.3])
        rows.append((1000 + i, (v * rng.choice([1, 5])).tolist(), int(i % 5 % 3)))
    rows += [(2000 + i, base[7].tolist(), 1) for i in range(9)]
    return rows


ODD = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [1.0, None] + [0.0] * 14, 1), (5004, [], 1), (5005, [1.0] * 16, None), (5006, [1.0] * 16, 1), (5007, [2.0] * 16, 1), (5008, [1.0] * 4, 1), (5009, [float("inf")] + [1.0] * 15, 1), (5010, [1e300] * 16, 1)]


@pytest.mark.parametrize(("block", "holds", "blocks"), [(256, 64, 2), (8, 64, 2), (256, 0.2, 3)])
def test_near_vectors_against_brute_force(spark, monkeypatch, block, holds, blocks):
    monkeypatch.setattr(cap_filters, "BLOCK", block)
    monkeypatch.setattr(cap_filters, "HOLDS", holds)
    assert len(cap_filters.CapFilters.plan(16, 500).books) == blocks
    rows = near_vectors() + ODD
    good = [(i, np.asarray(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = collections.Counter(), {i: i for i, _, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = [v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, v, _ in good]
    for x in range(len(good)):
        for y in range(x):
            if good[x][2] == good[y][2] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= 0.98:
                a, b = good[x][0], good[y][0]
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in cap_filters.near_vectors(df).collect()}
    assert len(got) == len(rows)
    # every link that is counted is one; nearly all are found, and where all of a component are, it is whole
    assert all(got[i].n_links <= links[i] for i in parent)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links.values())
    short = {find(i) for i in parent if got[i].n_links < links[i]}
    assert len(short) <= 2
    assert all((got[i].component_id, got[i].kept) == (find(i), find(i) == i) for i in parent if find(i) not in short)
    assert all(got[i].n_links == 0 and got[i].kept for i in (5000, 5001, 5002, 5003, 5004, 5005, 5008, 5009))
    assert got[5006].n_links == got[5010].n_links == 2


def test_list_decoding_is_complete():
    plan = cap_filters.CapFilters.plan(12, 5000)
    unit = np.random.default_rng(2).normal(size=(20, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    row, code = plan.decode(unit)
    turned = unit @ plan.rotation
    half = plan.books[0].shape[1]
    scores = (turned[:, :half] @ plan.books[0].T)[:, :, None] + (turned[:, half:] @ plan.books[1].T)[:, None, :]
    for i in range(20):
        flat = scores[i].ravel()
        own = np.sort(code[row == i])
        above = np.flatnonzero(flat >= plan.height)
        assert set(above) <= set(own) and (len(above) == len(own) or len(above) < cap_filters.LEAST <= len(own))
        assert flat[own].min() >= np.delete(flat, own).max()


def test_no_vectors(spark):
    assert cap_filters.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert cap_filters.near_vectors(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).count() == 1


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 540)] + [(600, i) for i in range(601, 650)]
    parent = {v: v for e in edges for v in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {v: find(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("one_task", [0, components.ONE_TASK])
def test_components_by_stars_and_in_one_task(spark, monkeypatch, one_task):
    """Stars, paths in shuffled order and loops; few edges take few jobs."""
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = np.random.default_rng(3)
    names = rng.permutation(400).astype(np.int64) * 7 - 900
    edges = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[k]) for k in range(101, 180)] + [(names[200], names[200])]
    edges += [(names[300 + i], names[300 + j]) for i, j in rng.integers(0, 100, (70, 2))]
    edges = [(int(a), int(b)) for a, b in edges]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    before = spark.range(1).count() and len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert len(got) == len(want) and dict(map(tuple, got)) == want
    assert not one_task or jobs <= 10


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline
    from tests_llm_fixture import corpus

    docs, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    held, names = table, list(corpus_pipeline.COLUMNS)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        held = corpus_pipeline.stored(stage(spark, held, str(tmp_path)), f"test-{name}")
        steps[name] = held.collect()
        if name != "bpe_codec":
            assert held.columns == names
    toxic = {d for d, _, t in labels if t}
    after = {r.doc_id for r in steps["toxicity"]}
    assert not after & toxic and len({d[0] for d in docs} - toxic - after) <= 2
    sets = {}
    for r in steps["toxicity"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    kept = {r.doc_id for r in steps["minhash_near_dedup"]}
    for i, s in sets.items():
        like = [j for j, t in sets.items() if j < i and s and t and 100 * len(s & t) >= 85 * len(s | t)]
        assert (i in kept) == (not like)
    assert {r.doc_id for r in steps["secret_scans"]} == kept
    assert not any("hunter2hunter2" in (r.text or "") for r in steps["secret_scans"])
    assert any("[secret]" in (r.text or "") for r in steps["secret_scans"])
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    assert math.isclose(words(steps["source_mixing"]), words(steps["secret_scans"]), abs_tol=3)
    assert len(steps["bpe_codec"]) == len(steps["source_mixing"])
    final = collections.Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert final == collections.Counter(map(tuple, steps["bpe_codec"]))


def test_pipeline_links_from_080_on(spark):
    import corpus_pipeline

    docs = []
    for i in range(80):
        words = [f"w{i}x{k}" for k in range(60)]
        docs.append((2 * i, " ".join(words)))
        words[30] = "new"  # five shingles; and up to three at the end
        words[60 - i % 4 :] = ["end"] * (i % 4)
        docs.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in docs}
    share = {d: len(sets[d] & sets[d - 1]) / len(sets[d] | sets[d - 1]) for d in sets if d % 2}
    assert sum(0.80 <= v < 0.85 for v in share.values()) >= 20 and min(share.values()) < 0.80
    assert got == {d for d in sets if d % 2 == 0 or share[d] < 0.80}
    from tessella.llm import near_dedup

    assert near_dedup.matches_at(85) == 12 and near_dedup.matches_at(80) == 9


def test_pipeline_keeps_one_of_repeated_and_unnamed_rows(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{w}{k}" for k in range(30)) for w in "abc")
    docs = [(1, one), (1, one), (1, two), (None, one), (None, three), (None, three), (None, None), (2, None), (2, None), (3, "x y")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df.repartition(3), "").collect())
    assert got == collections.Counter([(1, one), (1, two), (None, three), (None, None), (2, None), (3, "x y")])
