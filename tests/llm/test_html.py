"""Main text of pages whose markup doesn't say what is what: hand-written ones, and layouts that the model hasn't seen."""

import pytest

from reviewloom.llm import html_extract

P = "The old bridge over the river was closed in March after engineers had found cracks in two of its main piers."
Q = "Repairs will take until next summer, the council said on Tuesday, and drivers should use the northern road meanwhile."
D = "Die alte Brücke über den Fluss wurde im März gesperrt, nachdem Fachleute Risse in zwei Pfeilern gefunden hatten."
E = "Die Arbeiten dauern bis zum nächsten Sommer, teilte die Stadt mit, und der Verkehr wird so lange umgeleitet."
F = "Le vieux pont sur la rivière est fermé depuis le mois de mars, car deux de ses piles présentent des fissures."
G = "Les travaux dureront jusqu'à l'été prochain, a annoncé la mairie, et les voitures passeront par la route du nord."
S = "El puente viejo sobre el río está cerrado desde marzo, porque se hallaron grietas en dos de sus pilares."
J = "川に架かる古い橋は、二本の橋脚にひびが見つかったため、三月から通行止めになっている。工事は来年の夏まで続く見込みで、車は北の道を通るよう市は呼びかけている。歩行者のための仮橋は来月には完成するという。"

PAGES = [
    # the text in plain blocks, between a menu and an imprint
    (f"<div>menu</div><div><h1>Bridge plan</h1><div>{P} {Q}</div><div>{Q} {P} {P}</div></div><div>Copyright 2020 Some Company</div>", ["Bridge plan", f"{P} {Q}", f"{Q} {P} {P}"]),
    (f'<div class="kopf">menu</div><div class="inhalt"><h1>Bridge plan</h1><div>{P} {Q}</div><div>{Q}</div></div><div class="fusszeile">Copyright 2020 Firma</div>', ["Bridge plan", f"{P} {Q}", Q]),
    (f'<div class="kopf"><a href="/">Start</a> <a href="/b">Berichte</a></div><div class="inhalt"><h1>Plan für die Brücke</h1><p>{D}</p><p>{E}</p></div><div class="fuss">© Stadtblatt</div>', ["Plan für die Brücke", D, E]),
    (f'<div id="entete">Accueil | Villes | Sports</div><div id="texte"><h1>Le pont</h1><p>{F}</p><p>{G}</p></div><div id="bas">© Le Journal</div>', ["Le pont", F, G]),
    (f'<div id="cabecera"><a href="/">Inicio</a></div><div id="cuerpo"><h1>El puente</h1><p>{S}</p><p>{S} {S}</p></div><div>Copyright Diario</div>', ["El puente", S, f"{S} {S}"]),
    (f"<div><a href='/'>トップ</a> <a href='/n'>ニュース</a></div><div><h1>橋の計画</h1><p>{J}</p></div><div>© 新聞</div>", ["橋の計画", J]),
    # bare text
    (f"<p>{P}</p>", [P]),
    (f"<p>{P}</p><p>{P} {Q}</p>", [P, f"{P} {Q}"]),
    (f"<html><head><title>x</title></head><body><p>{P}<p>{Q}<p>{P}</body></html>", [P, Q, P]),
    (f"<h1>Bridge plan</h1><p>{P}</p><p>{Q}</p>", ["Bridge plan", P, Q]),
    (P, [P]),
    (f"{P}<br><br>{Q}", [f"{P} {Q}"]),
    (f"<div>{P}</div><div>{Q}</div>", [P, Q]),
    (f"<pre>{P}\n{Q}</pre>", [f"{P} {Q}"]),
    # tables for layout
    (f"<table><tr><td>Home News</td></tr><tr><td><h1>Bridge plan</h1><p>{P}</p><p>{Q} {P}</p></td></tr><tr><td>Imprint | Contact</td></tr></table>", ["Bridge plan", P, f"{Q} {P}"]),
    (f"<table><tr><td>Home News</td><td>{P} {Q}</td></tr><tr><td colspan=2>Imprint | Contact</td></tr></table>", [f"{P} {Q}"]),
    (f'<table><tr><td><a href="/">Home</a> <a href="/n">News</a></td></tr><tr><td><h1>Bridge</h1>{P} {Q}</td></tr><tr><td>Copyright 2001</td></tr></table>', ["Bridge", f"{P} {Q}"]),
    (f'<center><table><tr><td><a href="/">Home</a></td><td><p>{P}</p><p>{Q}</p></td></tr></table></center>', [P, Q]),
    # links and words around the text
    (f'<div><a href="/">Home</a> | <a href="/n">News</a> | <a href="/s">Sport</a></div><h1>Bridge</h1><p>{P}</p><p>{Q}</p><div><a href="/i">Imprint</a></div>', ["Bridge", P, Q]),
    (f'<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul><h1>Bridge</h1><p>{P}</p><h2>What comes next</h2><p>{Q}</p>', ["Bridge", P, "What comes next", Q]),
    (f'<div><a href="/">Home</a></div><div><div><div><h1>Bridge</h1><div>{P}</div><div>{Q}</div></div></div></div><div>&copy; 2024 Town Paper. All rights reserved.</div>', ["Bridge", P, Q]),
    (f"<div>Home News Sport</div><div><h1>Bridge</h1><p>{P}</p><ul><li>The northern road is open for all cars and lorries.</li><li>Cyclists can use the ferry at no charge until then.</li></ul><p>{Q}</p></div><div>Imprint | Privacy</div>", ["Bridge", P, "The northern road is open for all cars and lorries.", "Cyclists can use the ferry at no charge until then.", Q]),
    (f'<div>{P} <a href="/x">a map</a> {Q}</div><div><a href="/a">older</a> <a href="/b">newer</a></div>', [f"{P} a map {Q}"]),
    # where tags do say it, they count as before
    (f"<nav>Home</nav><article><h1>Bridge</h1><p>{P}</p><p>Short.</p></article><footer>{Q}</footer>", ["Bridge", P, "Short."]),
    (f'<div class="menu">{Q}</div><div class="article-body"><p>{P}</p></div><div class="comments"><p>{Q}</p></div>', [P]),
]


@pytest.fixture(scope="module")
def extractor():
    return html_extract.Extractor(html_extract.default_model())


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_page(extractor, i):
    page, want = PAGES[i]
    assert extractor.text(page).split("\n") == want


def wrong(model, pages):
    """Share of blocks with a wrong label."""
    e = html_extract.Extractor(model)
    found = [(k, int(html_extract.MARK in t)) for p in pages for k, t in e.labels(p)]
    return sum(a != b for a, b in found) / len(found)


@pytest.mark.parametrize("layout, most", [("divs", 0.02), ("nested", 0.03), ("bare", 0.02), ("breaks", 0.02), ("table", 0.25)])
def test_layouts_that_were_not_learned(layout, most):
    """The model is fitted without a layout and read on that one: a table's cells are the one thing that must be learned."""
    others = tuple(x for x in html_extract.LAYOUTS if x != layout)
    model = html_extract.fit(html_extract.labelled_pages(300, 8) + html_extract.loose_pages(400, 8, others), steps=120)
    assert wrong(model, html_extract.loose_pages(150, 77, (layout,))) <= most


def test_new_pages_of_the_learned_layouts():
    model = html_extract.default_model()
    assert wrong(model, html_extract.loose_pages(200, 99)) <= 0.015 and wrong(model, html_extract.labelled_pages(200, 98)) <= 0.004


def test_marks_are_no_feature():
    """Blocks of a labelled page have the features of the same page without marks."""
    for page in html_extract.labelled_pages(30, 5) + html_extract.loose_pages(30, 5):
        bits = [b for b, _ in html_extract.blocks(page)]
        plain = [b for b, _ in html_extract.blocks(page.replace(html_extract.MARK, ""))]
        size = sum(html_extract.BIT[n] for n in html_extract.NAMES if any(x in n for x in ("chars_", "links_", "longest", "half", "tenth", "prose", "by_", "first_", "last_", "h1")))
        assert len(bits) == len(plain) and all(a & ~size == b & ~size for a, b in zip(bits, plain))
