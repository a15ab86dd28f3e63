"""Main text of hand-made pages: what is article is said here, not by the extractor's own rules."""

from __future__ import annotations

import pytest

from pairfeat.llm import pages

TITLE = "A heading of the article"
TEXT = [" ".join(f"{w}{k}" for w in ("the", "river", "runs", "past", "old", "mills", "and", "slowly", "bends", "north")) + f" for the {k} time."
        for k in range(8)]
BODY = f"<h1>{TITLE}</h1>" + "".join(f"<p>{t}</p>" for t in TEXT)
WANT = "\n\n".join([TITLE, *TEXT])
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li><li><a href='/c'>News</a></li></ul>"
NAV, FOOT = f"<nav>{MENU}</nav>", "<footer>&copy; 2024 example.com</footer>"
HEAD = "<html><head><title>A heading of the article - example</title></head>"
COMMENTS = "<div class='comments'><p>Nice article, thanks a lot!</p><div class='comment-body'><p>I do not agree with this at all.</p></div></div>"
ASIDE = "<aside class='sidebar'><h3>Related</h3><ul><li><a href='/x'>Another story</a></li></ul></aside>"

SHELLS = {
    "article": f"{HEAD}<body>{NAV}<article>{BODY}</article>{FOOT}",
    "bare div": f"{HEAD}<body>{NAV}<div>{BODY}</div>{FOOT}",
    "body class with sidebar": f"{HEAD}<body class='single-post has-sidebar'>{NAV}<article>{BODY}</article>{FOOT}",
    "body class header-fixed": f"{HEAD}<body class='header-fixed'>{NAV}<main>{BODY}</main>{FOOT}",
    "no-sidebar content": f"{HEAD}<body>{NAV}<div class='no-sidebar content'>{BODY}</div>{FOOT}",
    "page form": f"{HEAD}<body><form id='form1'>{NAV}<div class='content'>{BODY}</div>{FOOT}</form>",
    "table layout": f"{HEAD}<body><table><tr><td class='menu'>{MENU}</td><td class='article'>{BODY}</td></tr></table>{FOOT}",
    "text-form section": f"{HEAD}<body>{NAV}<article><section class='text-form'>{BODY}</section></article>{FOOT}",
    "header in article": f"{HEAD}<body>{NAV}<article><header><h1>{TITLE}</h1></header>" + "".join(f"<p>{t}</p>" for t in TEXT) + f"</article>{FOOT}",
    "comments in article": f"{HEAD}<body>{NAV}<article>{BODY}{COMMENTS}</article>{FOOT}",
    "comments after": f"{HEAD}<body>{NAV}<main><div class='post'>{BODY}</div>{COMMENTS}</main>{FOOT}",
    "aside in main": f"{HEAD}<body>{NAV}<main><article>{BODY}</article>{ASIDE}</main>{FOOT}",
    "sidebar layout wrapper": f"{HEAD}<body><div class='layout sidebar-right'>{NAV}<div id='content'>{BODY}</div>{ASIDE}</div>{FOOT}",
    "genesis wrap": f"{HEAD}<body class='content-sidebar header-full-width'><div class='content-sidebar-wrap'><main class='content'>{BODY}</main>{ASIDE}</div>{FOOT}",
    "with-comments body": f"{HEAD}<body class='with-comments page-template'>{NAV}<div class='entry-content'>{BODY}</div>{COMMENTS}{FOOT}",
    "menu-open html": f"<html class='menu-open no-js'><head><title>x</title></head><body>{NAV}<main>{BODY}</main>{FOOT}",
    "camel case": f"{HEAD}<body class='hasSidebar'>{NAV}<div class='articleBody'>{BODY}</div>{FOOT}",
    "header class in article": f"{HEAD}<body>{NAV}<article><header class='entry-header'><h1>{TITLE}</h1></header><div class='entry-content'>"
                               + "".join(f"<p>{t}</p>" for t in TEXT) + f"</div></article>{FOOT}",
    "cookie notice": f"{HEAD}<body><div class='cookie-notice'><p>We use cookies to improve your visit.</p><button>OK</button></div>{NAV}<article>{BODY}</article>{FOOT}",
    "advert inside": f"{HEAD}<body>{NAV}<article><h1>{TITLE}</h1><p>{TEXT[0]}</p><div class='advert'>Buy two for one now.</div>"
                     + "".join(f"<p>{t}</p>" for t in TEXT[1:]) + f"</article>{FOOT}",
    "newsletter form": f"{HEAD}<body>{NAV}<article>{BODY}</article><form class='newsletter'><label>Your mail</label><button>Go</button></form>{FOOT}",
    "related articles": f"{HEAD}<body>{NAV}<main><article>{BODY}</article><section class='related'><article><h3><a href='/q'>Another piece</a></h3></article></section></main>{FOOT}",
    "comments as articles": f"{HEAD}<body>{NAV}<article class='post'>{BODY}</article><article class='comment'><p>I disagree with all of it.</p></article>{FOOT}",
    "nested divs": f"{HEAD}<body><div id='page'><div id='wrap'>{NAV}<div id='main'><div class='inner'><div class='story'>{BODY}</div></div></div></div></div>{FOOT}",
    "form and table": f"{HEAD}<body><form id='aspnetForm'><table><tr><td class='sidebar'>{MENU}</td><td><div class='content'>{BODY}</div></td></tr></table></form>",
    "page header": f"{HEAD}<body><header class='site-header'><p>Example news</p></header><main>{BODY}</main><div class='footer-widgets'><p>Contact us here</p></div>",
    "search box": f"{HEAD}<body><div class='search-form'><label>Search</label></div><article>{BODY}</article>{FOOT}",
    "breadcrumbs": f"{HEAD}<body><div class='breadcrumbs'><a href='/'>Home</a> <a href='/n'>News</a></div><main class='content'>{BODY}</main>{FOOT}",
    "ad-free article": f"{HEAD}<body>{NAV}<article class='post no-ads'>{BODY}</article>{FOOT}",
    "share bar": f"{HEAD}<body>{NAV}<article>{BODY}<div class='share-buttons'><a href='#'>Share</a></div></article>{FOOT}",
}


@pytest.fixture(scope="module")
def model(spark):
    return pages.train(pages.training_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))


@pytest.mark.parametrize("name", SHELLS)
def test_shell(model, name):
    cut = pages.blocks(SHELLS[name])
    assert "\n\n".join(b.text for b, m in zip(cut, pages.labels([cut], model)[0]) if m) == WANT


def test_query_on_shells(spark):
    """The operator over a table of the shells among the pages it is trained on."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    odd = spark.createDataFrame([(-k - 1, h) for k, h in enumerate(SHELLS.values())], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(table.union(odd), ["page_id"]).filter("page_id < 0").collect()}
    assert sum(t == WANT for t in got.values()) >= len(SHELLS) - 1


def test_network_in_double_precision(model):
    """Batched float32 labels against one page at a time in double precision, a step at a time."""
    import numpy as np
    for html in [*SHELLS.values(), "<p>one</p>"]:
        cut = pages.blocks(html)
        x = pages.vectors(cut).astype(np.float64)
        hidden = []
        for way in (0, 1):
            h = c = np.zeros(model.hidden)
            out = [None] * len(x)
            for t in range(len(x)) if way == 0 else reversed(range(len(x))):
                i, f, o, g = np.split(x[t] @ model.wx[way] + h @ model.wh[way] + model.b[way], 4)
                c = c / (1 + np.exp(-f)) + np.tanh(g) / (1 + np.exp(-i))
                h = np.tanh(c) / (1 + np.exp(-o))
                out[t] = h
            hidden.append(np.array(out))
        p = 1 / (1 + np.exp(-(np.concatenate(hidden, 1) @ model.wo + model.bo)))
        assert [bool(v) for v in p > 0.5] == pages.labels([cut], model)[0]
