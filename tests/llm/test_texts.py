"""PII surrogates, HTML wrappers, and the pipeline."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from loomery.llm import html_wrapper as hw
from loomery.llm import pii


def luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


TEXT = 'Write to Jane.Doe7@mail5.example.com or jane.doe7@mail5.example.com! IP 10.20.30.40, call +1 (555) 123-4567 or +15551234567. Card 4111 1111 1111 1111, SSN 123-45-6789. token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password=hunter2x9 Mr. Miller met Mary Miller. Иван Петров и Анна Петрова. IBAN DE89370400440532013000.'


def test_surrogates(shared):
    rows = [(1, TEXT), (2, TEXT), (3, None), (4, ""), (5, "nothing 1234 here, not 1.2.3"), (6, "x" * 100_000 + " a@b.cd"), (1, TEXT)]
    df = shared.createDataFrame([(i, x, 9, i) for i, x in rows], "doc_id long, text string, n_entities int, entity int")
    out = pii.replace_pii(df, "key").collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 7 and got[3].text is None and got[4].text == "" and got[5].text == rows[4][1] and got[5].n_entities == 0 and got[1].text == got[2].text
    new = got[1].text
    for private in ("Doe7", "10.20.30.40", "123-4567", "4111", "123-45-6789", "24be64", "hunter2x9", "Miller", "Mary", "Иван", "Петров", "DE89370400440532013000"):
        assert private.lower() not in new.lower(), private
    mails = re.findall(r"[\w.]+@[\w.]+\w", new)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower()  # one person in two spellings
    phones = re.findall(r"\+1[ \d()-]+\d", new)
    assert [re.sub(r"\D", "", x) for x in phones] == [re.sub(r"\D", "", phones[0])] * 2 and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    card = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}),", new)[1].replace(" ", "")
    assert luhn(card) == 0 and card[0] == "4"
    assert re.search(r'token = "[0-9a-f]{40}"', new) and re.search(r"password=[a-z]{6}\d[a-z]\d", new) and re.search(r"SSN 9\d\d-\d\d-\d{4}\.", new)
    assert re.search(r"IBAN DE\d{20}\.", new)
    a, given, b = re.search(r"Mr\. (\w+) met (\w+) (\w+)\.", new).groups()
    assert a == b and given in pii.STAND_INS["f", "latin"]  # the surname agrees, the gender too
    first, _, second, last = re.search(r"\. (\w+) (\w+) и (\w+) (\w+)\.", new).groups()
    assert first in pii.STAND_INS["m", "cyrillic"] and second in pii.STAND_INS["f", "cyrillic"] and last.endswith("а")
    assert got[6].n_entities == 1 and "a@b.cd" not in got[6].text
    other = pii.replace_pii(df.where("doc_id = 2"), "another key").first().text
    assert other != new and pii.replace_pii(df.limit(0), "key").count() == 0


def test_surrogates_stay_distinct(shared):
    """A format with few surrogates: clashes are hashed again, and no surrogate is a name that occurs."""
    names = [n for k, x in pii.GIVEN.items() if k[1] == "latin" for n in x]
    df = shared.createDataFrame([(i, f"met {n} Lang.") for i, n in enumerate(names)], "doc_id long, text string")
    found = pii.replace_pii(df, "key").collect()
    new = [re.search(r"met (\w+) (\w+)\.", r.text).groups() for r in found]
    assert len({g for g, _ in new}) == len(names) and not {g for g, _ in new} & set(names) and len({s for _, s in new}) == 1
    table = pii.assign(shared.createDataFrame([("email", f"{c}@x.yz") for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, normal string"), "k").collect()
    assert len({r.new for r in table if r.kind == "email"}) == 26 and max(r.attempt for r in table) > 0


def test_gender_stays_where_all_names_occur(shared):
    every = [(k, n) for k, x in pii.GIVEN.items() for n in x]
    rows = [(i, f"x {n} {dict(latin='Lang', cyrillic='Петров', greek='Ρίζος')[k[1]]}.") for i, (k, n) in enumerate(every)]
    got = {r.doc_id: r.text.split()[1] for r in pii.replace_pii(shared.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    assert len(got) == len(every) and len(set(got.values())) == len(every)
    for i, (k, _) in enumerate(every):
        assert got[i] in pii.STAND_INS[k] or (got[i][-1] in "aаα") == (k[0] == "f"), (k, got[i])


def test_bare_mentions(shared):
    rows = [(1, "Miller came. Mary Miller and Mr. Lang met; Miller said Lang's Millers, Mary, McMiller and miller know Thomas."), (2, "Miller alone, Mary too."), (3, "Иван Петров. Петров и Иванов.")]
    got = {r.doc_id: r for r in pii.replace_pii(shared.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    m = re.fullmatch(r"(\w+) came\. (\w+) (\w+) and Mr\. (\w+) met; (\w+) said (\w+)'s Millers, (\w+), McMiller and miller know Thomas\.", got[1].text)
    assert m and m[1] == m[3] == m[5] != "Miller" and m[2] == m[7] != "Mary" and m[4] == m[6] != "Lang" and got[1].n_entities == 7
    assert got[2].text == rows[1][1] and got[2].n_entities == 0
    m = re.fullmatch(r"(\w+) (\w+)\. (\w+) и Иванов\.", got[3].text)
    assert m and m[2] == m[3] != "Петров" and got[3].n_entities == 3


def test_secrets_phones_and_hosts_stay_apart(shared):
    rows = [(1, "token=AbCdEfGh12345XyZ token=aBcDeFgH12345xYz key 00FFaa11BBcc22DD44"), (2, "call +1 555 123 4567 or 555-123-4567"), (3, " ".join(f"u@{a}{b}.com" for a in "abcdefgh" for b in "abcdefgh"))]
    got = {r.doc_id: r.text for r in pii.replace_pii(shared.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    a, b, c = re.fullmatch(r"token=(\w+) token=(\w+) key (\w+)", got[1]).groups()
    assert a.lower() != b.lower() and re.fullmatch("([A-Z][a-z]){4}[0-9]{5}[A-Z][a-z][A-Z]", a) and re.fullmatch("([a-z][A-Z]){4}[0-9]{5}[a-z][A-Z][a-z]", b)
    assert re.fullmatch("[0-9]{2}[A-F]{2}[a-f]{2}[0-9]{2}[A-F]{2}[a-f]{2}[0-9]{2}[A-F]{2}[0-9]{2}", c)
    x, y = re.fullmatch(r"call \+1 (\d{3} \d{3} \d{4}) or (\d{3}-\d{3}-\d{4})", got[2]).groups()
    assert x.replace(" ", "-") == y != "555-123-4567"
    hosts = [m.split("@")[1] for m in got[3].split()]
    assert len(set(hosts)) == 64  # of 2028 short ones: some hash again
    with pytest.raises(ValueError):
        pii.replace_pii(shared.createDataFrame(rows, "doc_id long, text string"), "")


def test_names_after_cues(shared):
    rows = [(1, "My name is Tarik Oyelaran. Oyelaran called; Tarik left."), (2, "Zoe Smith-Jones, Olga Ivanova and Giorgos Papadopoulos met Dr. O'Neil and Mr McDonald."), (3, "Γιώργος Παπαδόπουλος"), (4, "Macron spoke. The Name is unknown")]
    got = {r.doc_id: r.text for r in pii.replace_pii(shared.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    m = re.fullmatch(r"My name is (\w+) (\w+)\. (\w+) called; (\w+) left\.", got[1])
    assert m and m[1] == m[4] != "Tarik" and m[2] == m[3] != "Oyelaran"
    assert not re.search("Zoe|Smith|Jones|Olga|Ivanova|Giorgos|Papadopoulos|Neil|Donald", got[2]) and re.match(r"\w+ \w+-\w+, \w+ \w+ and", got[2])
    assert re.fullmatch(r"[\u0370-\u03ff\u1f00-\u1fff]+ [\u0370-\u03ff]+", got[3]) and "Γιώργος" not in got[3] and got[4] == rows[3][1]


def test_entities_that_hash_again_by_a_join(shared, monkeypatch):
    """Whether they go with the plan or are joined, the texts are the same."""
    rows = [(i, f"{'abcdefgh'[i % 8]}@{'ab'[i % 2]}.com and 10.0.0.{i} Mary Smith") for i in range(60)]
    df = shared.createDataFrame(rows, "doc_id long, text string")
    once = sorted(map(tuple, pii.replace_pii(df, "key").collect()))
    monkeypatch.setattr(pii, "INLINE_BYTES", 0)
    assert sorted(map(tuple, pii.replace_pii(df, "key").collect())) == once


def test_plan_is_native(shared):
    df = shared.createDataFrame([(1, TEXT)], "doc_id long, text string")
    plan = pii.replace_pii(df, "key")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def page(body, n, title="T"):
    return f'<!DOCTYPE html><html lang="en"><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b{n}">B</a></li></ul></nav><div class="ad">Buy {n}</div>{body}<aside>Side {n}</aside><div id="comments"><p>Reader {n} says hi</p></div><form><input name=q><button>Go</button></form><footer>&copy; me</footer></body></html>'


def test_articles(shared):
    rows, want = [], {}
    for i in range(40):
        paras = [f"Paragraph {k} of page {i} &amp; more.<br>It  goes\non." for k in range(i % 4 + 1)]
        inner = f"<h1>Title {i}</h1><p><b>" + "<p>".join(paras) + "</p>" + ('<div class="notice cookie">We use cookies.</div>' if i % 2 else "")
        tag = "article" if i % 2 else 'div class="story"'
        rows.append((i, f"http://h{i % 2}.org/{i}", page(f"<{tag}>{inner}</{tag.split()[0]}>", i)))
        want[i] = "\n".join([f"Title {i}", *[f"Paragraph {k} of page {i} & more. It goes on." for k in range(i % 4 + 1)]])
    rows += [(100, "http://h0.org/x", None), (101, None, ""), (102, "no url", "<p>Only &lt;this&gt;"), (103, "http://h1.org/y", "<div" * 2000), (0, rows[0][1], rows[0][2])]
    df = shared.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string").repartition(6)
    out = hw.main_text(df)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"] and out.count() == len(rows)
    got = {r.page_id: r for r in out.collect()}
    assert {i: got[i].text for i in want} == want
    assert got[100].text == "" and got[101].text == "" and got[102].text == "Only <this>" and all(r.n_chars == len(r.text) for r in got.values())
    assert hw.main_text(df.limit(0)).count() == 0
    many = hw.main_text(df, keep=["page_id"])
    assert many.columns == ["page_id", "text", "n_chars"]


def test_joined_wrappers_give_the_same(shared, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/{i}", page(f"<article><p>Text {i}</p></article>", i)) for i in range(12)]
    df = shared.createDataFrame(rows, "page_id long, url string, html string")
    before = sorted(tuple(r) for r in hw.main_text(df, keep=["page_id"]).collect())
    monkeypatch.setattr(hw, "BROADCAST_BYTES", -1)
    assert sorted(tuple(r) for r in hw.main_text(df, keep=["page_id"]).collect()) == before == sorted((i, f"Text {i}", len(f"Text {i}")) for i in range(12))


def test_a_copied_article_is_no_template(shared):
    """Copies keep all their blocks however many they are; what all articles of a host show in a slot goes, there only."""
    copied, note = "<h1>Copied</h1><p>The copied text.</p><blockquote>A block of its own.</blockquote><h4>And another.</h4><p>More of it.</p>", "<pre>Set in our &amp; own type.</pre>"
    rows = [(i, f"http://mixed.org/{i}", page(f"<article><h1>Title {i}</h1><p>Text {i} is here.</p><blockquote>Home</blockquote>{note}</article>" if i < 3 else f"<article><h1>Title {i}</h1><p>Text {i} is here.</p>{note}</article>", i)) for i in range(12)]
    rows += [(100 + i, "http://mixed.org/copy", page(f"<article>{copied}{note}</article>", i)) for i in range(30)]
    rows += [(200 + i, "http://copies.org/", page(f"<article>{copied}</article>", i)) for i in range(8)]
    got = {r.page_id: r.text for r in hw.main_text(shared.createDataFrame(rows, "page_id long, url string, html string").repartition(4), keep=["page_id"]).collect()}
    text = "Copied\nThe copied text.\nA block of its own.\nAnd another.\nMore of it."
    assert {got[i] for i in got if i >= 100} == {text}
    assert all(got[i] == f"Title {i}\nText {i} is here." + ("\nHome" if i < 3 else "") for i in range(12))


def nodes(x):
    return [x, *[y for k in x.kids or () for y in nodes(k)]]


def shape(x):
    if x.kids is None:
        return "x+" if x.many else "x"
    return f"{x.label}({' '.join(map(shape, x.kids))}){'+' if x.many else ''}"


def test_alignment():
    tree = lambda x: hw.page(x)[0]
    one, two = "<div><ul><li>a</li><li>b</li></ul><p>x</p></div>", "<div><ul><li>a</li></ul><h2>t</h2><p>y</p></div>"
    assert shape(tree(one)) == "(div(ul(li(x)+) p(x)))"
    both = hw.meet(tree(one), tree(two))
    assert shape(both) == "(div(ul(li(x)+) h2(x) p(x)))"  # a repeated item, an optional heading
    assert [n.pages for n in nodes(both) if n.label in ("h2", "p", "div")] == [2, 1, 2]
    assert [n.text for n in nodes(both) if n.kids is None][-1] is None  # the texts differ
    assert shape(hw.meet(hw.unpacked(both.packed()), tree(one))) == shape(both)
    assert shape(tree("<dl>" + "<dt>a</dt><dd>b</dd>" * 3 + "</dl>")) == "(dl(+(dt(x) dd(x))+))"


def test_large_pages_stay_in_the_wrapper(monkeypatch):
    """Beyond the bounds a wrapper gets coarser, but has all pages and all their text."""
    monkeypatch.setattr(hw, "KIDS", 6)
    monkeypatch.setattr(hw, "NODES", 60)
    tags = "p h2 ul blockquote pre h3 table dl ol h4".split()
    made = [f"<body><div class='c{i}'>Menu</div><div>" + "".join(f"<{tags[(i + k * k) % 10]} class='k{'xyz'[k % 3] * (i % 4)}'>Text {i} {k}</{tags[(i + k * k) % 10]}>" for k in range(5 + 7 * i)) + "</div></body>" for i in range(12)]
    total = sum(len(x) for m in made for x in hw.page(m)[1])
    for order in (made, made[::-1]):
        w = None
        for m in order:
            w = hw.trimmed(hw.page(m)[0]) if w is None else hw.meet(w, hw.page(m)[0])
        assert w.pages == 12 and len(nodes(w)) <= 60 and sum(n.chars for n in nodes(w) if n.kids is None) == total
    judged = hw.Judge(w)
    assert all(f"Text {i} {k}" in hw.extract(m, judged) for i, m in enumerate(made) for k in range(5 + 7 * i))
    deep = "<div>" * 3000 + "inside" + "</div>" * 3000
    assert hw.extract(deep, None) == "inside" and hw.extract("<head><title>t</title><p>body text", None) == "body text"


def test_names_of_classes_alone_drop_nothing():
    kept = ['<p class="tag-line">Tag line.</p>', '<p id="legal-matters">Legal.</p>', '<div class="side-effects">Side effects.</div>', '<section class="related-work">Related work.</section>', '<p class="social-history">History.</p>', '<section id="skip-list">Skip lists.</section>']
    dropped = ['<div class="ad">Buy</div>', '<section id="comments"><p>First!</p></section>', '<div class="cookie-notice">We use cookies.</div>', "<form><input><button>Go</button></form>", "<aside>Side</aside>", "<footer>Foot</footer>", "<nav>Menu</nav>"]
    body = "<article><h1>Title</h1><p>The main text of it all, which is longer.</p>" + "".join(map("".join, zip(kept, dropped, strict=False))) + dropped[-1] + "</article>"
    want = "Title\nThe main text of it all, which is longer.\nTag line.\nLegal.\nSide effects.\nRelated work.\nHistory.\nSkip lists."
    assert hw.extract(body, None) == want
    root, _, mark = hw.page(body)
    assert hw.extract(body, hw.Judge(root, [mark])) == want


TEMPLATES = {
    "article": "<nav><a href=/>{m}</a></nav><article>{a}</article><footer>{f}</footer>",
    "main": "<header><h1>Site</h1></header><main>{a}</main><aside>{s}</aside><footer>F {f}</footer>",
    "content": "<div id='header'>Site name</div><div class='menu'><ul><li><a href=/>Home</a></li><li><a href=/x>{m}</a></li></ul></div><div class='content'>{a}<div class='ad'>{s}</div></div><div class='sidebar'><p>{s}</p></div><div id='footer'>{f}</div>",
    "comments": "<article>{a}<div class='advert'>{s}</div></article><section id='comments'><h3>Comments</h3><ol class='comment-list'><li><p>{s}</p></li><li><p>{f}</p></li></ol><form><textarea>x</textarea><button>Send</button></form></section>",
    "unnamed": "<div class='c1'><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></div><div class='c2'>{a}</div><div class='c3'><p>All rights reserved, Company 2024.</p></div>",
    "cookie": "<div class='cookie-banner'><p>We use cookies, {f}</p><button>OK</button></div><div class='wrap'><div class='post'>{a}</div><div class='notice'>Note {s}</div></div>",
    "nested": "<div id='page'><div id='main'><div class='article-body'>{a}</div></div><div class='widget-area'><div class='related-posts'><ul><li><a href=/1>{s}</a></li><li><a href=/2>{f}</a></li></ul></div></div></div>",
    "inside": "<main><article>{a}<section class='comments'><p>{s}</p><p>{f}</p></section></article></main>",
}


@pytest.mark.parametrize("name", TEMPLATES)
@pytest.mark.parametrize("count", [1, 3, 12])
def test_templates(name, count):
    """Made-up articles of headings, paragraphs, lists and quotes in templates of many kinds come out as they went in."""
    import random

    r = random.Random(f"{name}{count}")
    words = "river stone lamp cloud paper table green walk seven night bread glass".split()
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    pages = []
    for _ in range(count):
        out = [sentence(4)]
        html = f"<h1>{out[0]}</h1>"
        for k in range(r.randint(1, 8)):
            kind = r.choice(("p", "p", "p", "h2", "blockquote", "ul"))
            own = [sentence(r.randint(8, 60))] if kind in ("p", "blockquote") or not k else [sentence(3) for _ in range(1 if kind == "h2" else 3)]
            html += {"h2": "<h2>{}</h2>", "blockquote": "<blockquote><p>{}</p></blockquote>"}.get(kind, "<p>{}</p>").format(own[0]) if len(own) == 1 else "<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>"
            out += own
        pages.append((f"<html><head><title>x</title></head><body>{TEMPLATES[name].format(a=html, m=sentence(2), f=sentence(5), s=sentence(12))}</body></html>", "\n".join(out)))
    wrapper, marks = None, []
    for x, _ in pages:
        root, _, mark = hw.page(x)
        wrapper, marks = hw.trimmed(root) if wrapper is None else hw.meet(wrapper, root), hw._least(marks, [mark])
    judged = hw.Judge(wrapper, marks)
    assert [hw.extract(x, judged) for x, _ in pages] == [text for _, text in pages]


def unnamed(i, text):
    return f"<html><body><div><div><p>The Paper</p><p>Home</p><p>News</p><p>Sport and all that is going on around the town today</p></div><div><h1>Headline {i}</h1><div>{text}<div>Read our terms of use before writing to us.</div></div></div><div>Printed by us, in the town, for all who live there and beyond it.</div></div></body></html>"


def test_unnamed_chrome_goes_by_the_wrapper(shared):
    """Nothing has a name: what the pages share goes, what differs stays. A page by itself can't tell."""
    texts = {i: [f"Story {i} paragraph {k} has its own words {'so ' * (i * k % 7)}here." for k in range(1 + i % 4)] for i in range(24)}
    rows = [(i, f"http://paper.org/{i}", unnamed(i, "".join(f"<p>{x}</p>" for x in t))) for i, t in texts.items()]
    df = shared.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in hw.main_text(df, keep=["page_id"]).collect()}
    want = {i: "\n".join([f"Headline {i}", *t]) for i, t in texts.items()}
    assert got == want
    alone = {i: hw.extract(x, None) for i, _, x in rows}
    assert all(alone[i] != want[i] and all(x in alone[i] for x in texts[i]) for i in alone)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_pipeline(shared):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "near-duplicates", "decontamination", "packing"]
    before = shared.read.parquet(f"{SF}/documents.parquet")
    columns, docs, sizes = before.columns, before, [before.count()]
    for _, stage in cp.STAGES[:-1]:
        docs = stage(shared, docs, SF)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    last = cp.run(shared, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    # each stage's work is done: nothing that it would take out is left
    assert cp.drop_near_duplicates(shared, docs, SF).count() == docs.count() and cp.drop_contaminated(shared, docs, SF).count() == docs.count()


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_pipeline_by_brute_force(shared):
    """Each stage on its own input against plain loops."""
    from collections import Counter

    import corpus_pipeline as cp
    from test_copies import brute_fp, brute_lines, linked
    from test_search import brute

    from loomery.llm import toxicity

    docs, labels = shared.read.parquet(f"{SF}/documents.parquet"), shared.read.parquet(f"{SF}/labels.parquet")
    rows = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    start = rows(docs)
    kept = cp.drop_toxic(shared, docs, SF)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels), keep=["doc_id"]).collect()}
    first = rows(kept)
    assert first == {i: x for i, x in start.items() if scores[i] < 0.7}
    lines = cp.dedup_lines(shared, kept, SF)
    second = rows(lines)
    assert second == brute_lines(sorted(first.items())) and {r.doc_id: r.n_chars for r in lines.collect()} == {i: len(x) for i, x in second.items()}
    apart = cp.drop_near_duplicates(shared, lines, SF)
    third = rows(apart)
    fps = {i: brute_fp(x) for i, x in second.items()}
    root = linked(sorted(set(fps.values())))
    least: dict = {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    assert third == {i: second[i] for i in least.values()}
    clean = cp.drop_contaminated(shared, apart, SF)
    bench = [(r.item_id, r.text) for r in shared.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fourth = rows(clean)
    windows = [(i, x) for i, x in bench if x]
    grams = {g for _, x in windows for g in _grams(x)}
    assert fourth == {i: x for i, x in third.items() if not any(g in grams for g in _grams(x))}
    some = sorted(set(third) - set(fourth))[:2]
    assert all(brute(third[i], windows)[1] > 0 for i in some)
    pieces = cp.pack(shared, clean, SF).collect()
    fill = Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and {r.doc_id for r in pieces} == set(fourth)
    total = sum(fill.values())
    assert len(fill) <= -(-total // 1024) * 1.02 + 1


def _grams(text):
    """Runs of ten words; the tables' items have no fewer."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 10]) for k in range(len(w) - 9)}


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_pages_by_brute_force(shared):
    """The article element of each page, cut by a pattern of its own."""
    import html

    def article(page):
        inner = re.sub(r"<br\s*/?>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner))
        return "\n".join(b for b in blocks if b)

    pages = shared.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in hw.main_text(pages, keep=["page_id"]).collect()}
    assert got == {r.page_id: article(r.html) for r in pages.collect()}


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_surrogates_by_brute_force(shared):
    """Plain patterns find nothing of the old values in the new texts; equal values have equal surrogates, others others, and the text between stays."""
    kinds = [r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", r"\b\d{3}-\d{2}-\d{4}\b", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\(\d{3}\) ?\d{3}-\d{4}", r"\b[3-6]\d{3}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}\b"]
    docs = shared.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    old = {r.doc_id: r.text for r in docs.collect()}
    new = {r.doc_id: r.text for r in pii.replace_pii(docs, "key").collect()}
    found = 0
    for kind in kinds:
        pairs: dict = {}
        for i, x in old.items():
            a, b = re.findall(kind, x, re.A), re.findall(kind, new[i], re.A)
            assert len(a) == len(b), (kind, i)
            for p, q in zip(a, b, strict=True):
                assert p != q and pairs.setdefault(p.lower(), q.lower()) == q.lower()
                assert re.sub("[A-Za-z0-9]", "", p.split("@")[0]) == re.sub("[A-Za-z0-9]", "", q.split("@")[0])  # the format stays
        assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())
        found += len(pairs)
    assert found > 5


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op3_decontamination", "op8_line_dedup"])
def test_oracle(shared, name):
    import duckdb

    from loomery.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = QUERIES[name](shared, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.execute(ORACLE_SQL[name]).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert (got == want).all().all() and len(got)


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_all_queries_keep_their_rows(shared):
    from loomery.llm.queries import QUERIES

    n = shared.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_pii_surrogates", "op4_spotsigs", "op6_token_counts", "op7_toxicity", "op9_simhash", "op10_token_files"):
        assert QUERIES[name](shared, SF).count() == n, name
