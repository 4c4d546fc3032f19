"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into blocks at block-level tags. Each block has its word count and link density, those of its two
neighbours, whether it is a heading or a list item, and, as further features, what the containers around it say: how
far they name it the article (``main``: 2 by their tag, 1 by a name) and how far something else (``doubt``: 2 for menus,
footers, comments and the like, 1 where only part of a name says so, or in forms). A decision tree keeps or drops a
block. Where nothing is named it sees counts, links and neighbours only; that side is grown from the labelled blocks
without names. Named blocks, which may be as long as the article's, are judged by all features. If no block is kept, the
page is a short one, and all its blocks that are neither links nor doubtful are kept.

Scripts, styles, comments of the markup, titles and form fields hold no text at all. Character references are decoded,
white space in a block becomes one space, kept blocks are joined by one space in page order. Unclosed and crossed tags
are closed with their container. Of elements without text, raw ones (scripts and the like) that nothing closes reach to
the page's end, others to the next block. A comment or a quoted value that nothing closes is read as browsers and plain
tags have it. Null html counts as empty and gives an empty text. Pages of any length are read whole, in time linear in
their length, however broken. Repeated rows are judged one by one; columns other than page_id, url and html aren't
looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import give_back

#: Tags by what they do. Fixed values. Raw ones hold no markup; silent ones hold none of the page's text.
RAW = frozenset("script style title textarea iframe".split())
SILENT = frozenset("noscript template select option button svg math object canvas datalist".split())
#: Silent ones that can't lie in each other: a second one ends the first.
SINGLE = frozenset("button option select".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form fieldset ul ol dl table tbody thead tr figure details dialog menu blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre hr address figcaption caption legend summary center".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
GOOD_TAGS, BAD_TAGS = frozenset("article main".split()), frozenset("nav header footer aside fieldset menu dialog".split())
#: Words in class, id and role. Strong ones name what isn't the article wherever they stand, weak ones only among
#: words that say nothing of their own; a state is no name. Fixed values.
STRONG = frozenset(
    "ad ads advert adverts advertisement adsense adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar widget related recommended recommendations share sharing comment comments commentlist replies respond disqus cookie cookies consent popup modal overlay newsletter subscribe subscription signup pagination pager toolbar contentinfo complementary".split()
)
WEAK = frozenset("header side social alert notice login form search tags copyright legal skip reply promoted notification disclaimer gdpr".split())
EMPTY = frozenset(
    "list lists link links box container wrap wrapper inner outer left right top bottom main site page global primary secondary button buttons btn bar block area section content contents item items post posts story stories article articles news more latest popular most read mobile desktop sticky fixed small large big new text title head heading body row col column columns group panel unit slot space view center thread media icon icons icon field fields input results result go to back message messages holder module footer header user author meta info".split()
)
STATE = frozenset("has is no not with without show hide js open opened closed enabled disabled visible hidden layout theme template type format status".split())
GOOD_WORDS = frozenset("article articlebody content main post entry story body text prose".split())
ON_ARTICLE = frozenset("ad ads advert advertisement comment comments reply sponsored".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
CAMEL, SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[^a-z]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
SILENT_TAGS = re.compile(rf"<(/?)({'|'.join(sorted(SILENT))})(?=[\s/>])[^>]*+>", re.I)
LONG_NUMBER = re.compile(r"&#(?:0*+([0-9]*+)|[xX]0*+([0-9a-fA-F]*+));?")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "main", "doubt")
#: Those that no name gives.
PLAIN = len(FEATURES) - 2


def decoded(text: str) -> str:
    """Text with its character references decoded; numbers of any length."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = LONG_NUMBER.sub(lambda m: m[0] if len(m[0]) < 12 else (f"&#{m[1]};" if m[1] is not None else f"&#x{m[2]};") if len(m[1] or m[2] or "") < 8 else "\ufffd", text)
    return markup.unescape(text)


@lru_cache(1 << 14)
def named(token: str) -> tuple[bool, int]:
    """Whether one name says that a container holds the article, and how far that it doesn't (0, 1 or 2)."""
    words = [w for w in SPLIT.split(CAMEL.sub("-", token).lower()) if w]
    if not words or words[0] in STATE or words[-1] in STATE:
        return False, 0
    strong, weak, good = not STRONG.isdisjoint(words), not WEAK.isdisjoint(words), not GOOD_WORDS.isdisjoint(words)
    if good and weak and not strong and "header" in words and "page" not in words and "main" not in words:
        return True, 0  # the article's own head
    if not (strong or weak):
        return good, 0
    own = STRONG.union(WEAK, EMPTY).issuperset(words)
    return False, 2 if own else 1 if strong else 0


def hints(tag: str, attributes: str, main: int) -> tuple[int, int]:
    """How far a container says that it holds the article, and that it doesn't; ``main`` is what those around it say."""
    good = 2 if tag in GOOD_TAGS else 0
    doubt = 2 if tag in BAD_TAGS and not (tag == "header" and main) else 1 if tag == "form" else 0
    if attributes and tag not in ("html", "body"):
        for m in NAMES.finditer(attributes):
            for token in (m[1] or m[2] or m[3] or "").split():
                if good == 2:
                    words = [w for w in SPLIT.split(token.lower()) if w]
                    doubt = 2 if words and not ON_ARTICLE.isdisjoint(words) and ON_ARTICLE.union(EMPTY).issuperset(words) else doubt
                else:
                    g, d = named(token)
                    good, doubt = max(good, int(g)), max(doubt, d)
    return good, doubt


def silent_ends(page: str) -> dict[int, int]:
    """Where silent elements end, by where their content starts; those that nothing closes aren't in it."""
    opened: dict[str, list[int]] = {t: [] for t in SILENT}
    found: dict[int, int] = {}
    for m in SILENT_TAGS.finditer(page):
        at = opened[m[2].lower()]
        if m[1]:
            if at:
                found[at.pop()] = m.end()
        elif m[0][-2] != "/":
            if m[2].lower() in SINGLE:
                at.clear()
            at.append(m.end())
    return found


def tags(page: str, at: int = 0) -> Iterator[tuple[int, int, str, bool, str]]:
    """Tags of a page from ``at`` on: start, end, lower-case name ("" for comments and the like), whether it closes, attributes.

    The consumer may send a place from which to go on.
    """
    last, plain = page.rfind(">"), False  # plain: some quoted value has no end, so none is looked for any more
    while (at := page.find("<", at)) >= 0:
        sign = page[at + 1 : at + 2]
        if sign == "!" and page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            end = end + 3 if end >= 0 else len(page)
            name, closes, attributes = "", False, ""
        elif at > last:
            return
        elif sign in ("!", "?") and sign:
            cdata = page.find("]]>", at) if page.startswith("<![CDATA[", at) else -1
            end = cdata + 3 if cdata >= 0 else page.find(">", at) + 1
            name, closes, attributes = "", False, ""
        else:
            m = None if plain else TAG.match(page, at)
            if m:
                end, name, closes, attributes = m.end(), m[2].lower(), bool(m[1]), m[3]
            elif n := NAME.match(page, at):
                end = page.find(">", n.end()) + 1
                plain = True
                if not end:
                    return
                name, closes, attributes = n[1].lower(), sign == "/", page[n.end() : end - 1]
            elif sign == "/":
                end, name, closes, attributes = page.find(">", at) + 1, "", True, ""
            else:
                at += 1
                continue
        to = yield at, end, name, closes, attributes
        at = max(end, to or 0)


def extent(page: str, at: int, own: str) -> int:
    """Where a silent element without a closing tag ends: at a block, at the next one of its kind or with what it lies in."""
    opened: Counter = Counter()
    for start, _, tag, closes, attributes in tags(page, at):
        if tag and (tag in BLOCKS or tag == own or closes and not opened[tag]):
            return start
        if tag and tag not in VOID and not attributes.endswith("/"):
            opened[tag] += -1 if closes else 1
    return len(page)


def blocks(page: str) -> list[tuple[str, tuple]]:
    """(text, own features) of each block: words, link density, heading, list item, main, doubt."""
    out: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked = 0  # words in links
    stack: list[tuple[str, int, int]] = []  # open containers: tag, main, doubt
    depth: Counter = Counter()
    main = doubt = 0
    in_link, tag_now, at = False, "", 0
    silent = silent_ends(page)
    gone: set[str] = set()  # raw tags that nothing closes

    def close() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            heading, item = tag_now[:1] == "h" and tag_now[1:2].isdigit(), tag_now in ("li", "dt", "dd", "td", "th")
            out.append((" ".join(words), (len(words), min(1.0, linked / len(words)), heading, item, main, doubt)))
        parts.clear()
        linked = 0

    found = tags(page)
    step = next(found, None)
    while True:
        text = page[at : step[0] if step else len(page)]
        if text:
            text = decoded(text)
            parts.append(text)
            if in_link:
                linked += len(text.split())
        if not step:
            break
        _, at, tag, ends, attributes = step
        if not ends and (tag in RAW or tag in SILENT) and not (attributes.endswith("/") and tag in SILENT):
            if tag in SILENT:
                at = silent[at] if at in silent else extent(page, at, tag)
            else:
                m = None if tag in gone else RAW_END[tag].search(page, at)
                if m is None:
                    gone.add(tag)
                at = m.end() if m else len(page)
            parts.append(" ")
        elif tag == "a":
            in_link = not ends
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            close()
            in_link = False
            tag_now = "" if ends else tag
            around = stack[-1] if stack else ("", 0, 0)
            if tag in CONTAINERS:
                if ends:
                    while depth[tag] and stack:
                        top = stack.pop()[0]
                        depth[top] -= 1
                        if top == tag:
                            break
                else:
                    good, bad = hints(tag, attributes, around[1])
                    # an article ends a slight doubt about what it lies in, the main part any
                    before = 0 if tag == "main" or tag == "article" and around[2] == 1 else around[2]
                    stack.append((tag, max(around[1], good), max(before, bad)))
                    depth[tag] += 1
                _, main, doubt = stack[-1] if stack else ("", 0, 0)
            else:
                _, main, doubt = around
                if not ends and attributes:
                    doubt = max(doubt, hints(tag, attributes, main)[1])
        try:
            step = found.send(at)
        except StopIteration:
            step = None
    close()
    return out


def features(found: list[tuple[str, tuple]]) -> np.ndarray:
    """A row per block, with its neighbours' word counts and link densities."""
    own = np.array([f for _, f in found], float).reshape(-1, 6)
    none = np.zeros((1, 2))
    before, after = np.concatenate([none, own[:-1, :2]]), np.concatenate([own[1:, :2], none])
    return np.concatenate([own[:, :2], before, after, own[:, 2:]], axis=1)


#: The labelled table: pages whose blocks begin with + (main text) or - (not).
PAGES = (
    '<body><nav><ul><li><a href="/a">-Home</a></li><li><a href="/b">-News</a></li></ul></nav><article><h1>+A storm came in</h1><p>+The storm reached the coast at night and took roofs with it.</p><p>+Nobody was hurt.</p></article><footer>-Copyright of the paper, all rights reserved, write to us for more</footer></body>',
    '<body><div class="ad">-Buy two and pay for only one of them today in all our shops</div><article><h1>+Bread</h1><p>+Flour, water and salt.</p><ul><li>+Mix the flour with the water</li><li>+Wait</li></ul><aside>-Read our other recipes</aside><p>+Bake it for an hour until it is dark.</p></article></body>',
    '<body><header>-The Daily Page <a href="/">-home</a></header><main><h2>+Rates go up again</h2><p>+The bank raised its rates for the third time this year, to nobody\'s surprise.</p><blockquote>+We had no choice</blockquote><div class="share"><a href="#">-Share</a> on your page</div></main><aside class="sidebar"><h3>-Most read</h3><p>-Ten ways to save money that nobody told you about before</p></aside></body>',
    '<body><div id="content"><h1>+Walls</h1><p>+Old walls of <a href="/x">stone</a> stand along the river.</p><p>+They are old.</p><div class="comments"><p>-I saw these walls last year and they were beautiful, thank you for writing</p><p>-Me too</p></div></div><div class="cookie-notice">-We use cookies to give you the best experience on this site</div></body>',
    '<body><p>+Plain page with a paragraph of text and no containers at all around it, as old pages have.</p><p>+Another paragraph that follows with quite a few words in it too.</p><table><tr><td><a href="1">-One</a></td><td><a href="2">-Two</a></td></tr></table></body>',
    '<body><form>-Your name <input> -and your mail address please</form><section class="story"><p>+She left the town in spring.</p><p>+He stayed and kept the shop until it burned down in the dry summer of that year.</p></section><section class="comments"><h3>-Comments</h3><p>-Great story, I was there myself and can say that it is true in every part</p></section></body>',
    '<body><div class="menu"><a href="a">-Start</a> <a href="b">-Blog</a></div><div class="wrap"><h1>+Notes on bees</h1><p>+Bees find their way by the sun, and tell others by a dance in the dark hive.</p><p>+<b>They sleep.</b></p><p>+So do we.</p></div><div class="footer"><p>-Made by hand in a small town, with thanks to all who helped us</p></div></body>',
    '<body><article><header><h1>+Title in a header</h1></header><div class="newsletter">-Sign up for our letter and get it each week for free</div><p>+Text of the article that goes on for a while and then ends.</p><p>+<a href="z">See the whole list of what was found there</a></p><div class="related"><a href="r">-Next story</a></div></article></body>',
    '<body><div role="navigation"><a href="1">-Up</a></div><div class="banner">-Sale ends on Sunday at midnight so hurry</div><div><p>+What the river carries away in spring it brings back in autumn, so they say here.</p><p>+It is a slow river.</p></div><div><a href="p">-Previous</a> <a href="n">-Next</a></div><div class="copyright">-All rights reserved by the owners of this page</div></body>',
    '<body><div class="alert notice"><p>-This site will be down on Monday for work on the machines</p></div><main><article><p>+One</p><p>+Two words</p><p>+Three words here</p><pre>+code stays</pre></article><section id="comments"><p>-First</p><p>-I do not agree with what is said here about the river at all</p></section></main><footer><p>-About</p></footer></body>',
    '<body><nav>-Menu without links</nav><div class="ad">-Short</div><article><p>+A</p></article><footer>-x</footer></body>',
    '<body><ul><li><a href="1">-World</a></li><li><a href="2">-Sports</a></li><li><a href="3">-Weather today</a></li></ul><h1>+How ice forms</h1><p>+Ice forms from the top down, since cold water below four degrees rises.</p><p>+That is why fish live.</p><p><a href="4">-More</a></p></body>',
    # short and linked parts of an article beside links that aren't its own
    '<body><nav><a href="1">-Home</a></nav><article><h1>+Glass</h1><p>+Sand.</p><p>+<a href="2">Read how it is made</a></p><p>+Heat.</p></article><footer><a href="3">-Imprint</a></footer></body>',
    '<body><article><p>+Cold.</p></article><nav><a href="1">-Older</a> <a href="2">-Newer</a></nav><div class="ad">-Coats</div></body>',
    '<body><div class="ad">-Lifts of all kinds</div><main><p>+Up.</p><p><a href="1">+All about lifts</a></p><p>+Down.</p></main></body>',
    '<body><ul><li><a href="1">-Map</a></li></ul><article><p>+Left, then right.</p><ul><li><a href="2">+Left</a></li><li><a href="3">+Right</a></li></ul></article><p><a href="4">-All maps</a></p></body>',
    '<body><main><p>+<a href="1">All about the lifts of this town and the next one</a></p><p>+They go up and come down again.</p></main></body>',
    '<body><article><p>+Lifts go up.</p><p>+<a href="1">All about the lifts of this town</a></p><p>+And they come down again, as a rule.</p></article></body>',
    '<body><main><h2>+Tin</h2></main><footer><a href="1">-Metals</a></footer></body>',
    # pages without any names: word counts, links and neighbours must do
    '<body><div><a href="1">-Home</a> <a href="2">-About us</a> <a href="3">-Contact</a></div><h2>+How the mill was built</h2><p>+The mill was built in the year of the great flood by two brothers who had come over the hills with their tools.</p><p>+Short line.</p><p>+It ran for a hundred years, and when the river was turned it stood still and was used as a barn.</p><div>-Share this page</div><div><a href="4">-More mills of the valley</a></div><div><a href="5">-Old bridges</a></div><h3>-Most read</h3><ul><li><a href="6">-Ten ways to mend a wheel</a></li><li><a href="7">-A barn in winter</a></li></ul><div>-Powered by a small engine</div></body>',
    '<body><div><a href="1">-Start</a></div><div>-Today</div><div><a href="2">-World</a> <a href="3">-Money</a></div><div>-Weather</div><div><a href="4">-Sports and games</a></div><div><h1>+The last ferry</h1><p>+The last ferry left at nine, as it had done each evening since the war, with four cars and a dog on it.</p><p>+Nobody waved.</p><p>+In the morning the bridge was opened, and the old captain was the first one to walk over it.</p><p>+He said nothing.</p></div></body>',
    '<body><p>+First there was only the sea, and the sea had no name, for nobody was there to give it one.</p><p>+Then.</p><p>+Then came those who could not swim, and they called it the end of the world and turned round.</p><div>-Tags</div><div><a href="1">-sea</a> <a href="2">-names</a></div><div>-Next</div><div><a href="3">-What the hills remember</a></div><div>-All rights reserved</div></body>',
    '<body><table><tr><td><a href="1">-Shop</a></td><td><a href="2">-Cart</a></td><td>-Total</td><td><a href="3">-Pay now</a></td></tr></table><h1>+Oil lamps</h1><p>+An oil lamp needs three things, which are a wick of cotton, clean oil and somebody who trims it every day.</p><h2>+The wick</h2><p>+A wick that is cut straight burns with an even flame and does not smoke, so cut it with sharp scissors.</p><table><tr><td>+Oil</td><td>+Hours</td></tr><tr><td>+Olive</td><td>+Ten</td></tr></table><p>+Store lamps dry.</p><h3>-See also</h3><ul><li><a href="4">-Candles</a></li><li><a href="5">-Gas light in towns</a></li></ul></body>',
    '<body><div><a href="1">-Blog</a></div><h1>+A note</h1><p>+We moved to the new house in May, and the boxes are still in the hall, which <a href="2">as you know</a> is narrow.</p><p>+More soon.</p><p>-Posted by a friend <a href="3">-Permalink to it</a></p><div><a href="4">-Older</a></div><div>-Archive</div><div><a href="5">-May</a> <a href="6">-June</a></div></body>',
    "+Just one line of text and nothing else.",
    "<body><h1>+Rain</h1><p>+It rained.</p></body>",
    "<body><h1>+Fog</h1><p>+Fog lay on the fields.</p></body>",
    "<p>+He came.</p><p>+She had left that morning.</p>",
    "+Nothing else was said.",
    "<body><p>+Rain fell on the town all day.</p><p>+Then it snowed until the roads were closed and the shops shut early.</p></body>",
    # names that say part of it, forms around a page, headings of what isn't the article
    '<body class="has-sidebar search-open"><form id="aspnetForm"><div><h1>+Salt roads</h1><p>+Salt was carried over the pass on the backs of mules, twelve days there and ten days back again.</p><p>+The toll was paid in salt as well, which is why the toll house has such thick and dry walls.</p></div><div>-Your name</div><div>-Send</div></form><aside><h3>-Most read stories this week</h3><p>-One</p></aside></body>',
    '<body><article class="article search-results"><h1>+What the survey found</h1><p>+Half of all wells held clean water.</p><p>+One.</p><footer><h4>-Contact us by mail today</h4><p>-Sent from our office on the second floor of the old town hall, mornings only</p></footer></article><section class="comments"><h3>-Three readers said this about it</h3><p>-I do not think that half of all wells is anything to be proud of</p></section></body>',
    '<body><div id="legal-history"><h1>+Law in the marshes</h1><p>+No judge would go into the marshes, so the people there held court themselves, on a raft.</p><p>+It sank.</p></div><div class="comments-by-readers-of-old"><p>-Fun read</p><p>-Thanks</p><p>-More please</p></div><div class="menu-of-the-day-story"><p>+The cook, who had been at sea for thirty years, still served fish on every day but one, and would not say why.</p><p>+Soup, bread and fish were all that he knew, and all that anybody had ever asked him for in that town.</p></div></body>',
    '<body><header><h1>-The Evening Paper of the whole valley</h1></header><div class="post"><div class="entry-header"><h1>+Night trains</h1></div><p>+They run again.</p><p><a href="1">+A map of all lines that run at night</a></p><ul><li>+North</li><li>+South by the coast</li></ul></div><div class="related-posts"><h2>-You may like these as well</h2><ul><li><a href="2">-Slow boats</a></li></ul></div></body>',
    '<body><div id="content"><div><a href="1">-Up</a></div><div><a href="2">-News</a> <a href="3">-Local</a></div><h1>+The bell</h1><p>+The bell was cast twice, since the first one cracked when it was rung for the bishop in hard frost.</p><p>+It still rings.</p><div><a href="4">-Print</a></div><div><a href="5">-Send to a friend</a></div></div><div id="footer">-Made with care</div></body>',
    '<body><form action="/search">-Find <input></form><form><fieldset><legend>-Write to us</legend><p>-Your mail address will not be shown to anybody, and fields with a star must be filled in</p></fieldset></form><main><p>+Go.</p><p>+The race was over before those at the back had heard the shot that began it.</p><form>-Vote for the best runner <input></form></main><dialog><p>-This site keeps small files on your machine to remember what you like</p></dialog></body>',
    '<body><article><p>+Yes.</p><nav><a href="1">-On this page</a></nav><p>+<a href="2">Read the first part</a></p><div class="ad-slot">-Fresh coffee to your door</div><p>+That was all he said before he left, and nobody who was in the room has ever told why.</p><aside>-He was born in the north and lived by the sea for most of his long life</aside></article><ol class="commentlist"><li>-I was in that room</li><li>-So was I, and he said rather more than that, as I remember it to this day</li></ol></body>',
)


#: Further labelled pages, on which nothing is named, with sentences around the text, before a heading, behind its end.
NAMELESS = (
    '<body><div>-Accueil</div><div>-Actualités</div><div>-Nous écrire</div><p>+Le moulin fut construit par deux frères venus de la montagne avec leurs outils et une vieille mule.</p><p>+La rivière fut détournée trente ans plus tard, et depuis ce jour la roue ne tourne plus que pendant les crues.</p><p>+On y garde aujourd\'hui le foin, les charrettes et tout ce dont personne ne se sert au village.</p><div>-Recevez notre lettre gratuite chaque semaine.</div><div>-Tous droits réservés, 2021.</div></body>',
    '<body><p>-Start</p><p>-Shop</p><p>-Help</p><h1>+The glass road</h1><p>+For two hundred years the glass of the valley was carried down to the sea on the backs of men and women.</p><p>+They walked by night, as the frost of the early morning made the stones of the road safe for those with loads.</p><p>-Write to us for a free list of our books.</p><p>-Printed in the north. All prices with tax.</p></body>',
    '<body><div>-Now with more sugar and at half the price.</div><h1>+Bees in winter</h1><p>+In winter the bees hang together in a ball, and those on the outside change places with those within it.</p><p>+They do not sleep.</p><p>+When it gets warm enough they fly out once, on a clear day, and come back before the sun is low.</p><div>-The Valley Press, third floor, open on weekdays.</div></body>',
    '<body><div>-Our new coats are in the shops since Monday.</div><h1>+Ice on the lake</h1><p>+The lake froze over in the first week of the year, and by the second one there were carts on it.</p><p>+In March it broke with a noise that could be heard in the next town, and took a bridge with it.</p><div>-lake.example - a page of the old harbour office.</div></body>',
    '<body><div><a href="1">-Top</a></div><div>-Fresh bread each morning, also on Sundays.</div><h1>+Three bridges</h1><p>+The first bridge was of wood, and it went down the river with the ice in the year in which it was built.</p><p>+The second one stood.</p><p>+It was pulled down only when lorries came, since two of them could not pass each other on its narrow back.</p><div>-Bridges and roads, a small page about large things.</div></body>',
    '<body><div>-Login</div><div>-Register</div><div>-Search</div><div>-News from the harbour of today</div><p>+The ship came in at noon with half of its cargo under water and the rest of it on fire, to the joy of all.</p><p>+The captain went home.</p><p>+He had been on his feet for three days and slept for two, and when he woke up he could not be made to speak of it.</p><div>-Share</div><div>-Print</div><div>-Send</div><div>-Ask for our free guide to the harbour</div><div>-Part of the coast network</div></body>',
    '<body><p>-Home</p><p>-Team</p><p>-Press</p><p>-Jobs</p><p>+What the hills give in autumn they take back in spring, and those who live on them know when to move their sheep.</p><p>+There is no law about it, and no book, and whoever asks is told to look at the birds, which is good advice.</p><p>+We looked at them for a whole year and moved our sheep on the same day as all the others, to their great surprise.</p><p>-Join our club and save on every visit</p><p>-Rights of all pictures with their makers</p></body>',
    '<body><div>+The road to the pass is open from May to October, and closed at night for all carts that are not drawn by mules.</div><div>+At the top there is a house.</div><div>+Whoever stays there is asked to leave some wood by the door for those who will come up in the snow after them.</div></body>',
    '<body><h2>+Soap</h2><p>+Soap is made of fat and ash, and of patience, since it has to be stirred for as long as the sun is up.</p><h2>+Candles</h2><p>+Candles are made of the same fat, but without the ash, and by those who have no patience left for soap.</p><p>+Both smell.</p></body>',
)
#: Labelled orders of blocks on such pages: + or -, h for a heading, i for a list item, l for a link, and the words.
ORDERS = (
    "-1 -1 -1 +24 +21 +30 -9 -7",
    "-1 -1 -1 -1 +h4 +35 +42 +28 -5 -4",
    "-1 -2 -1 +h5 +40 +3 +55 +31 -8 -6",
    "-2 -1 -3 -1 +26 +60 +4 +33 -2 -5 -3",
    "-1 -2 +22 +19 +25 -3 -4 -4",
    "-3 -2 -2 +h3 +18 +22 +48 -10 -8",
    "-1 -1 -1 -1 -1 +29 +34 +20 -11 -9 -2",
    "-2 -2 +h6 +70 +5 +44 +2 +39 -6 -7",
    "-9 +h6 +33 +47 +21 -12",
    "-8 +h5 +28 +4 +36 +50 -10",
    "-7 +h9 +41 +22 +58 -11",
    "-10 +h12 +37 +64 +80 +45 -9",
    "-6 +h14 +25 +120 +33 -13",
    "-8 +h11 +8 +90 +27 +5 +61 -10",
    "-7 +h8 +52 +3 +6 +44 -14",
    "-9 +h10 +66 +30 -8 -3",
    "-1 -8 +h7 +34 +52 -9 -1 -2",
    "-4 +h5 +27 +31 +40 -7",
    "-1 -1 +23 +2 +35 +3",
    "-1 -1 -2 +40 +27 +4",
    "+h3 +30 +28 +4 +41",
    "+h4 +22 +3 +2 +45 +2",
    "+h2 +19 +6 +33",
    "+34 +7 +29 +12 +51",
    "+45 +40 +38",
    "+60 +9 +8 +70 +3",
    "+4 +1",
    "+4 +3",
    "+5 +2 +6",
    "+3 +4",
    "+6",
    "+3",
    "+2 +8",
    "+1 +4 +3",
    "+7 +5",
    "+h2 +3",
    "+h1 +2",
    "+h4 +6 +3",
    "-l1 -l1 -l1 +h5 +44 +30 +5 +52 -9",
    "-l1 -l2 -l1 -l1 +h4 +33 +28 -l3 -l4 -7",
    "-l1 -l1 -8 +h9 +37 +49 +26 -10",
    "-il1 -il1 -il1 -il1 -il1 -8 +h12 +48 +20 +99 -12",
    "-il1 -il1 -il1 -il1 -7 +h10 +31 +14 +72 +9 +40 -9",
    "-il1 -il1 -il1 -9 +h7 +13 +66 +8 +25 -11",
    "-il2 -il1 -il1 -6 +h11 +80 +3 +12 +35 -8",
    "-il1 -il1 -il1 -il1 -10 +h8 +55 +28 -10",
    "-i1 -i1 -i2 +h3 +25 +31 -8",
    "-i1 -i1 -i1 -i1 +h6 +44 +5 +38 -5 -6",
    "+h3 +26 +i4 +i6 +i3 +30",
    "+h4 +33 +i2 +i9 +i12 +22 +5",
    "+30 +l4 +28",
    "+h3 +40 +l6 +5 +36 -l2 -l3",
    "-1 -1 -1 +50 +33 -5",
    "-2 -1 -1 -2 +31 +48 +9 +27 -3 -8 -5 -4",
    "-1 -1 -1 -1 +38 +6 +7 +42 +55 -6 -2",
    "-1 -4 +29 +37 +41 -2 -4 -5",
    "-2 -2 -2 +36 +58 +22 -3 -6 -8",
    "-1 -3 +46 +31 +24 +60 -4 -3",
    "-3 -1 +21 +27 -5 -5",
    "-1 -1 -2 -1 +h2 +27 +33 +8 +45 -7 -9",
)
ORDER = re.compile(r"([+-])(h?)(i?)(l?)(\d+)")


TELLING = re.compile(r"<(/?)(?:" + "|".join(sorted(GOOD_TAGS | BAD_TAGS)) + r")\b|\s(?:class|id|role)=\"[^\"]*\"")


def bare(page: str) -> str:
    """A page without names, and with ``div`` for tags that tell what they hold."""
    return TELLING.sub(lambda m: f"<{m[1]}div" if m[0][0] == "<" else "", page)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the blocks of the labelled pages."""
    tables = [blocks(page) for page in PAGES]
    return np.concatenate([features(found) for found in tables]), np.array([t.startswith("+") for found in tables for t, _ in found], int)


def labelled_nameless() -> tuple[np.ndarray, np.ndarray]:
    """Those of blocks that nothing names: of the labelled pages, twice each, and of the nameless pages and orders."""
    x, y = labelled()
    own = ~x[:, PLAIN:].any(axis=1)
    xs, ys = [x[own], x[own]], [*y[own], *y[own]]
    for page in NAMELESS:
        found = blocks(bare(page))
        xs.append(features(found))
        ys += [int(t.startswith("+")) for t, _ in found]
    for order in ORDERS:
        parts = [ORDER.fullmatch(part).groups() for part in order.split()]
        xs.append(features([("", (int(n), float(bool(link)), bool(head), bool(item), 0, 0)) for _, head, item, link, n in parts]))
        ys += [int(sign == "+") for sign, *_ in parts]
    return np.concatenate(xs)[:, :PLAIN], np.array(ys)


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int = 1):
    """A CART tree by Gini impurity: (feature, threshold, low side, high side), or a leaf's share of main text."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            k = int(low.sum())
            if min(k, len(y) - k) < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            cost = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t)
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-12:
        return float(y.mean())
    _, f, t = best
    low = x[:, f] <= t
    return f, float(t), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@lru_cache(1)
def tree(depth: int = 9):
    """Blocks that nothing names go down a side of counts, links and neighbours alone, all others one of all features."""
    plain, named = grow(*labelled_nameless(), depth, 2), grow(*labelled(), depth)
    return PLAIN + 1, 0.5, (PLAIN, 0.5, plain, named), named


def share(node, row: np.ndarray) -> float:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None, model=None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    model = tree() if model is None else model
    rows = features(found)
    kept = [share(model, row) >= 0.5 for row in rows]
    if not any(kept):  # all of a page that has only short blocks
        kept = [row[1] < 0.5 and not row[-1] for row in rows]
    return " ".join(t for (t, _), k in zip(found, kept) if k)


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars."""
    model = tree()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h, model) for h in b.html]
            yield pd.DataFrame({"page_id": b.page_id, "url": b.url, "text": text, "n_chars": [len(t) for t in text]})
        give_back()

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(each, "page_id long, url string, text string, n_chars long")
