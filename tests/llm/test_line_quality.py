import random

import duckdb
import pytest

from tallyspark.llm import line_quality
from tallyspark.llm.queries import ORACLES


def brute(text):
    """The base counts, position by position."""
    text = text or ""
    space = "\t\n\v\f\r "
    words, now = [], ""
    for c in text + " ":
        if c in space:
            words += [now] if now else []
            now = ""
        else:
            now += c
    covered = set()
    for i in range(len(words) - 2):
        if sum(words[j : j + 3] == words[i : i + 3] for j in range(len(words) - 2)) > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.strip(space)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_counts_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", "#", " ", " ", "\n", "\t", "\x1c", "\xa0", "😀"]) for _ in range(rng.randint(0, 80)))
        assert line_quality.measured(text)[0] == brute(text), repr(text)


def prose(rng, lines, words=12):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    return [" ".join(word() for _ in range(words)) for _ in range(lines)]


def brute_verdicts(rows, limit=20, share=0.6):
    """{position: (words in common lines, kept)}: every document against every line of its host."""
    split = [[" ".join(x.split()).lower() for x in text.split("\n") if x.split()] for _, text, _ in rows]
    whole = [" ".join(text.split()).lower() for _, text, _ in rows]
    out = {}
    for i, (_, text, host) in enumerate(rows):
        gone = 0
        for line in split[i]:
            having = {whole[j] for j, (_, _, h) in enumerate(rows) if h == host and line in split[j]}
            gone += len(line.split()) if len(having) > limit else 0
        counts = brute(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        out[i] = gone, not failed and gone <= share * counts[0]
    return out


@pytest.fixture(scope="module")
def site(documents):
    """Pages that share menus, near copies and exact copies of a page, a page of little else than the menus, and a short one."""
    rng = random.Random(8)
    menus = prose(rng, 3, 31)
    menu = menus[0]
    rows = [(i, "\n".join([menu.upper() if i % 2 else f" {menu}\t", *menus[1:], *prose(rng, 6)]), "shop") for i in range(60)]
    page = prose(rng, 9)
    rows += [(100 + i, "\n".join(page[:i % 9] + prose(rng, 1) + page[i % 9 + 1 :]), "shop") for i in range(60)]
    copied = prose(rng, 9)
    rows += [(200 + i, "\n".join(copied), "shop") for i in range(60)]
    rows += [(300, "\n".join([*prose(rng, 1), *menus]), "shop"), (301, "\n".join([*prose(rng, 1), *menus]), "blog"), (302, menu, "shop")]
    for size in (20, 21, 25):  # a menu in as many documents as the limit, and in more
        shared = prose(rng, 1, 20)
        rows += [(400 + 30 * size + i, "\n".join([*shared, *prose(rng, 5)]), "wiki") for i in range(size)]
    return documents(rows), menu, rows


def test_shared_lines_go_and_depleted_documents_are_rejected(site):
    docs, menu, _ = site
    rows = {r.doc_id: r for r in line_quality.judged(docs).collect()}
    assert all(rows[i].kept and rows[i].n_removed_words == 93 for i in range(60))
    assert not any(rows[i].kept for i in range(100, 160))  # 60 different documents share nearly all their lines
    assert all(rows[i].kept and not rows[i].common for i in range(200, 260))  # exact copies are one document
    assert not rows[300].kept and not rows[300].base_failed and rows[300].n_removed_words == 93
    assert rows[301].kept  # another host
    texts = {r.doc_id: r.text for r in line_quality.cleaned(docs).collect()}
    assert set(texts) == {i for i, r in rows.items() if r.kept}
    assert all(menu not in texts[i].lower() and len(texts[i].split()) == 72 for i in range(60)) and menu in texts[301]
    assert [rows[400 + 30 * n].n_removed_words for n in (20, 21, 25)] == [0, 20, 20]


def test_verdicts_equal_brute_force(site):
    docs, _, rows = site
    want = brute_verdicts(rows)
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in line_quality.judged(docs).collect()}
    assert got == {rows[i][0]: v for i, v in want.items()}


def test_pages_that_are_mostly_banner_are_rejected(documents):
    """1,000 pages of a banner of 60 words and 30 words of their own, and a menu in 1,000 pages that stay."""
    rng = random.Random(2)
    banner, menu = prose(rng, 1, 60), prose(rng, 1, 15)
    rows = [(i, "\n".join([*banner, *prose(rng, 1, 30)]), "ads") for i in range(1000)]
    rows += [(2000 + i, "\n".join([*menu, *prose(rng, 1, 60)]), "news") for i in range(1000)]
    verdicts = {r.doc_id: (r.kept, r.n_removed_words) for r in line_quality.judged(documents(rows)).collect()}
    assert all(verdicts[i] == (False, 60) for i in range(1000)) and all(verdicts[2000 + i] == (True, 15) for i in range(1000))


def test_verdicts_equal_sql(spark, site):
    docs = site[0]
    rows = docs.collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in rows])
    want = con.execute(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({ORACLES['op6_quality']})").fetchall()
    got = line_quality.judged(docs).select("doc_id", *line_quality.NAMES, "base_failed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows(odd):
    rows = line_quality.judged(odd).collect()
    assert len(rows) == odd.count()
    assert {tuple(r[2:7]) for r in rows if r.doc_id in (1, 2, 5)} == {(0, 0, 0, 0, 0)}
    kept = line_quality.cleaned(odd)
    assert kept.columns == odd.columns and kept.collect() == []
    assert line_quality.judged(odd.limit(0)).collect() == [] and line_quality.cleaned(odd.limit(0)).collect() == []


def test_repeated_rows_are_judged_one_by_one(documents):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, text), (1, text), (2, text)])
    assert [r.kept for r in line_quality.judged(docs).collect()] == [True] * 3
    assert sorted(r.doc_id for r in line_quality.cleaned(docs).collect()) == [1, 1, 2]
