import numpy as np
import pytest

from surveyalign.llm import html_text as H
from surveyalign.llm.html_blocks import leaves
from surveyalign.llm.page_layouts import Layout

WORDS = [f"word{i}" for i in range(300)] + ["the", "and", "of", "house.", "river,"]


@pytest.fixture(scope="module")
def model():
    return H.train(WORDS)


def texts(page):
    return [b.text for b in leaves(page)]


def test_blocks_of_sound_and_broken_markup():
    assert texts("<p>one &amp; two&nbsp;three<p>four <b>five</b><br>six</p>seven") == ["one & two three", "four five six", "seven"]
    assert texts("<p><b>a<br><p>b</p>") == ["a", "b"]
    assert texts("<script>var a='<p>x</p>';</script>y<style>p{}</style><!-- <p>z</p> -->w<textarea>no</textarea>") == ["yw"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("a < b &lt; c &#233;&#x20AC; <3") == ["a < b < c é€ <3"]
    assert texts("<div title='a > b'>x</div><div title=\"unclosed>y</div>z") == ["x", "y", "z"]
    assert texts("<script>never closed <p>x") == [] and texts("<!-- open <p>x") == [] and texts("x<p") == ["x"]
    assert texts(None) == texts("") == texts(" \n ") == texts("<br><img src=a>") == []
    assert texts("</p></div>x</body>y") == ["x", "y"]
    assert len(texts("<div>" * 3000 + "deep")) == 1
    assert len(texts("<p>word " * 20000)) == 20000


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    pages = [H._labelled(Layout(WORDS, seed)) for seed in range(3)]
    blocks, labels = H.featurize([b for b, _ in pages]), np.array([x for _, own in pages for x in own], np.float32)
    model = H.Labeller.fresh(1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    kept = (rng.random((len(labels), H.PATH_SIZE + H.WORD_SIZE + H.MEASURES)) > 0.2).astype(np.float32)
    grad = model.gradients(blocks, labels, np.ones_like(kept))

    def loss():
        s = model.scores(blocks).astype(np.float64)
        return np.mean(np.log1p(np.exp(-s)) * labels + np.log1p(np.exp(s)) * (1 - labels))

    for name, g in grad.items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        step = 1e-2
        model.weights[name][i] += step
        up = loss()
        model.weights[name][i] -= 2 * step
        down = loss()
        model.weights[name][i] += step
        assert (up - down) / (2 * step) == pytest.approx(g[i], rel=0.05, abs=2e-4), name


def test_held_out_layouts_are_labelled_right(model):
    made = [m for m in (H._labelled(Layout(WORDS, seed)) for seed in range(5000, 5150)) if m[0]]
    scores = model.scores(H.featurize([b for b, _ in made]))
    labels = np.array([x for _, own in made for x in own])
    assert ((scores > 0) == labels).mean() > 0.98


def test_context_of_a_page_counts(model):
    page = ("<html><body><header><h1>My site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-banner'><p>We use cookies.</p></div>"
            "<article><h1>A title</h1><p>First paragraph of the story.</p><div class=ad>Buy now</div><p>Second one, with <a href=x>a link</a>.</p></article>"
            "<section id=comments><h3>Comments</h3><div class=comment><p>I agree with the story.</p></div></section>"
            "<aside class=sidebar><h3>Related</h3><ul><li><a href=y>Another story</a></li></ul></aside><form><label>Name</label><input></form>"
            "<footer>&copy; 2024 My site</footer></body></html>")
    blocks = leaves(page)
    assert H.main_text(blocks, model.scores(H.featurize([blocks]))) == (
        "A title\n\nFirst paragraph of the story.\n\nSecond one, with a link.")


def test_batches_do_not_change_scores(model):
    pages = [H._labelled(Layout(WORDS, seed))[0] for seed in range(20)] + [[]]
    together = model.scores(H.featurize(pages))
    alone = np.concatenate([model.scores(H.featurize([p])) for p in pages])
    assert np.allclose(together, alone, atol=1e-4)


def test_extraction_frame(spark, sf_dir, model):
    rows = [(1, "u", None, 0), (1, "u", "", 1), (None, None, "<article><p>Only text here, in an article.</p></article>", 2), (3, "u", "<nav><li><a>Home</a></nav>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = H.extract_main_text(pages, model)
    assert found.columns == ["page_id", "url", "text"]
    assert sorted((str(r.page_id), r.text) for r in found.collect()) == [("1", ""), ("1", ""), ("3", ""), ("None", "Only text here, in an article.")]
    assert H.extract_main_text(pages.limit(0), model).count() == 0 and H.sample_words(pages.limit(0), "page_id", "html") == []


def test_given_pages_equal_their_articles(spark, sf_dir):
    import html as references
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = H.train(H.sample_words(pages, "page_id", "html"))
    found = {r.page_id: r.text for r in H.extract_main_text(pages, model).collect()}
    right = 0
    for row in pages.collect():
        article = re.search("<article>(.*?)</article>", row.html, re.S)[1]
        parts = (" ".join(references.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        right += found[row.page_id] == "\n\n".join(p for p in parts if p)
    assert right >= 0.98 * len(found)


def test_carried_column_named_text_keeps_its_name(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "own")], "page_id long, html string, text string")
    found = H.extract_main_text(pages, H.train(["a", "b"]), carry=("text",))
    assert found.columns == ["page_id", "text", "text_"]
    assert [r["text"] for r in found.select("text").collect()] == ["own"]


def blocks(page):
    from surveyalign.llm.html_blocks import leaves

    return [b.text for b in leaves(page)]


def test_raw_text_ends_at_its_own_tag_only():
    assert blocks("<p>a</p><script src=/x/>var a=1;</script><p>b</p>") == ["a", "b"]
    assert blocks("<p>a</p><script src='x' />if (a < b) '</p>';</script ><p>b</p>") == ["a", "b"]
    assert blocks("<title>t</title><style>p > q</style><textarea><p>no</textarea>b<iframe>x</iframe>") == ["b"]
    assert blocks("<p>a<script>never closed <p>b") == ["a"]


def test_hidden_elements_end_with_their_parent():
    assert blocks("<div><button>menu</div><p>article</p>") == ["article"]
    assert blocks("<p>a <button>x</button> b</p>") == ["a b"]
    assert blocks("<div><svg><text>1</text><svg><text>2</text></svg><text>3</text></svg>tail</div>") == ["tail"]
    assert blocks("<p>a <svg/> b</p><noscript><p>no</p></noscript><p>c</p>") == ["a b", "c"]
    assert blocks("<div><select><option>one<option>two</select> kept</div>") == ["kept"]


def test_comments_formulas_and_unquoted_links():
    from surveyalign.llm.html_blocks import leaves

    assert blocks("<!--><p>a</p><!---><p>b</p><!-- x --!><p>c</p><!-- open <p>d") == ["a", "b", "c"]
    assert blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>") == ["so x=2 holds"]
    assert [(b.text, b.link_chars) for b in leaves("<p><a href=/foo/>text</a> more</p>")] == [("text more", 4)]
    assert [(b.text, b.link_chars) for b in leaves('<p><a name="x"/>text</p>')] == [("text", 0)]
    assert blocks("") == blocks(None) == []


def test_sampled_words_come_from_whole_blocks(spark):
    from surveyalign.llm.html_text import sample_words

    text = " ".join(f"w{i}" for i in range(500))
    pages = spark.createDataFrame([(1, f"<p>{text}</p>"), (2, "<p>w1 z</p>"), (3, None)], "page_id long, html string")
    assert sample_words(pages, "page_id", "html") == sorted({*text.split(), "z"})
    assert sample_words(pages.limit(0), "page_id", "html") == []
