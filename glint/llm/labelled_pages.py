"""Labelled pages to train the extraction of main text on: (html, main), main being the texts of the article's blocks in page order.

Pages are put together by rule from parts that sites commonly have, in many arrangements of tags and class names, around invented
words; on a share of the pages names mean nothing, so that shape and order have to be learnt too.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Ways to open what isn't the article, by its part; names are those that sites use.
_PARTS = {
    "menu": ["<nav>", "<div class='nav'>", "<div class='menu'>", "<div id='navigation'>", "<div class='navbar main-menu'>", "<ul class='menu'>", "<div role='navigation'>", "<div class='breadcrumbs'>", "<div class='pagination'>", "<nav class='breadcrumb'>", "<menu>", "<ul>"],
    "header": ["<header>", "<div class='header'>", "<div id='masthead'>", "<div class='site-header'>", "<div class='topbar'>", "<header class='page-header'>", "<div role='banner'>", "<div id='logo'>"],
    "footer": ["<footer>", "<div class='footer'>", "<div id='footer'>", "<div class='site-info'>", "<div class='copyright'>", "<footer class='site-footer'>", "<div role='contentinfo'>", "<div class='legal'>"],
    "side": ["<aside>", "<div class='sidebar'>", "<div id='sidebar'>", "<div class='widget'>", "<div class='related'>", "<section class='recommended'>", "<div class='popular-posts'>", "<aside class='rail'>", "<div role='complementary'>", "<div class='more-stories'>", "<td class='left'>", "<div class='trending'>"],
    "notice": ["<div class='cookie'>", "<div class='cookie-banner'>", "<div id='consent'>", "<div class='notice'>", "<div role='alert'>", "<div class='alert'>", "<dialog>", "<div class='popup'>", "<div class='modal overlay'>", "<noscript>", "<div class='gdpr'>", "<div class='disclaimer'>", "<section class='warning'>", "<div class='message'>", "<div class='paywall'>", "<p class='notice'>", "<p class='notification'>"],
    "advert": ["<div class='ad'>", "<div class='ads'>", "<div class='advert'>", "<div class='advertisement'>", "<aside class='ad'>", "<div class='sponsored'>", "<div class='promo'>", "<div><ins class='adsbygoogle'>", "<div id='ad-slot'>", "<div class='ad-container'>", "<section class='promoted sponsor'>", "<p class='ad'>", "<figure class='ad'>"],
    "form": ["<form>", "<form class='search'>", "<form id='newsletter'>", "<form class='login'>", "<div class='subscribe'><form>", "<fieldset>", "<div class='signup'>", "<div class='newsletter'>", "<form role='search'>"],
    "comments": ["<section id='comments'>", "<div class='comments'>", "<div class='comment'>", "<ol class='comment-list'>", "<div id='disqus'>", "<div class='discussion'>", "<section class='reader-comments'>", "<div class='replies'>", "<div class='responses'>", "<article class='comment'>", "<ul class='comments'>", "<div class='feedback reviews'>"],
    "share": ["<div class='share'>", "<div class='social'>", "<ul class='share-buttons'>", "<div class='tags'>"],
}
#: Ways to open the article.
_ARTICLES = ["<article>", "<main>", "<main><article>", "<div class='content'>", "<div id='content'>", "<div class='post'>", "<div class='entry-content'>", "<div class='article-body'>", "<article class='post'>", "<section class='story'>", "<div id='main'><div class='text'>", "<div role='main'>", "<main id='content'><div class='article'>", "<td class='content'>", "<div>", "<article><section>", ""]
_FILLER = ["row", "col", "wrap", "inner", "box", "block", "x1", "container", "grid", "css"]


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.main: list[str] = []
        self.names = self.rng.random() < 0.92  # else the page's names mean nothing

    def opened(self, start: str) -> tuple[str, str]:
        """The start tags, without a page's names if they mean nothing, and the end tags."""
        if "class=" in start and not self.names:
            start = start.split("class=")[0] + f"class='{self.rng.choice(_FILLER)}{self.rng.randrange(9)}'>"
        tags = [t.split()[0].strip("<>") for t in start.replace("><", "> <").split("> ")] if start else []
        return start, "".join(f"</{t}>" for t in reversed(tags))

    def words(self, low: int, high: int, stop: bool = True) -> str:
        r = self.rng
        made = ["".join(r.choice("bcdfglmnprst") + r.choice("aeioué") for _ in range(r.randrange(1, 4))) + r.choice(["", "", "n", "s", "", ","]) for _ in range(r.randrange(low, high))]
        if r.random() < 0.1:
            made = [w + r.choice(["%%%", "***", "&&&", "###", "$$$", "!!"]) for w in made]
        if r.random() < 0.1:
            made[r.randrange(len(made))] = str(r.randrange(3000))
        text = " ".join(made).rstrip(",")
        return text[:1].upper() + text[1:] + (r.choice("..." if r.random() < 0.9 else "!?") if stop else "")

    def inline(self, text: str, links: float) -> str:
        out = []
        for w in escape(text, quote=False).split(" "):
            x = self.rng.random()
            out.append(f"<a href='/{len(out)}'>{w}</a>" if x < links else f"<b>{w}</b>" if x > 0.97 else w)
        return " ".join(out)

    def say(self, tag: str, low: int, high: int, links: float = 0.0, main: bool = False, stop: bool = True) -> str:
        text = self.words(low, high, stop)
        if main:
            self.main.append(text)
        end = "" if tag in ("p", "li") and self.rng.random() < 0.1 else f"</{tag.split()[0]}>"
        return f"<{tag}>{self.inline(text, links)}{end}"

    def paragraph(self) -> str:
        r = self.rng
        kind = r.random()
        low, high = r.choice([(1, 3), (3, 12), (10, 60), (40, 160)])
        if kind < 0.06:
            text = self.words(low, high, r.random() < 0.7)
            self.main.append(text)
            tag = r.choice(["b", "b", "i", "em", "strong", "span", "u"])
            return f"<p><{tag}>{escape(text, quote=False)}" + r.choice(["<br>", f"</{tag}></p>", f"</{tag}>"])
        if kind < 0.72:
            return self.say("p", low, high, r.choice([0, 0, 0.03, 0.1]), True, r.random() < 0.9)
        if kind < 0.78:
            return self.say(r.choice(["h2", "h3"]), 1, 9, 0, True, r.random() < 0.3)
        if kind < 0.86:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(self.say("li", 1, 25, r.choice([0, 0.1]), True, r.random() < 0.6) for _ in range(r.randrange(2, 6))) + f"</{tag}>"
        if kind < 0.9:
            return "<blockquote>" + self.say("p", 5, 60, 0, True) + "</blockquote>"
        if kind < 0.93:
            return "<figure>" + self.say("figcaption", 3, 20, 0, True) + "</figure>"
        if kind < 0.96:
            return "<table>" + "".join("<tr>" + "".join(self.say("td", 1, 6, 0, True, False) for _ in range(3)) + "</tr>" for _ in range(r.randrange(1, 4))) + "</table>"
        if kind < 0.98:
            return self.say("div", low, high, 0, True)
        return self.say("pre", low, high, 0, True)

    def article(self) -> str:
        r = self.rng
        start, end = self.opened(r.choice(_ARTICLES))
        out = [start]
        if r.random() < 0.85:
            head = self.say("h1", 2, 14, 0, True, r.random() < 0.4)
            out.append(f"<header>{head}</header>" if r.random() < 0.1 else head)
        for _ in range(r.choice([0, 1, 2, 4, 8, 15, 30])):
            out.append(self.paragraph())
            if r.random() < 0.07 and start and self.names:
                out.append(self.part(r.choice(["advert", "advert", "side", "form", "notice", "share", "menu"])))
        if start and self.names and r.random() < 0.15:
            out.append(self.part("comments"))
        if start and self.names and r.random() < 0.05:
            out.append(self.part("footer"))
        return "".join([*out, end])

    def part(self, kind: str) -> str:
        r = self.rng
        start, end = self.opened(r.choice(_PARTS[kind]))
        items = lambda n, links: "".join(self.say("li", 1, 5, links, False, False) for _ in range(n))
        if kind in ("menu", "share"):
            if start.startswith(("<ul", "<menu")):
                body = items(r.randrange(2, 9), 1.0)
            else:
                body = r.choice([f"<ul>{items(r.randrange(2, 9), 1.0)}</ul>", " ".join(self.say("a", 1, 3, 0, False, False) for _ in range(r.randrange(2, 7)))])
        elif kind == "header":
            body = r.choice(["", self.say("h1", 1, 5, 0, False, False), self.say("a", 1, 4, 0, False, False), self.say("p", 2, 9)]) + (f"<ul>{items(4, 1.0)}</ul>" if r.random() < 0.4 else "")
        elif kind == "footer":
            body = r.choice([self.say("p", 3, 20, 0.1), "&copy; " + self.words(2, 20), f"<ul>{items(5, 1.0)}</ul>", "&copy; " + self.words(1, 5, False) + " &middot; " + self.words(3, 12)])
        elif kind == "side":
            body = r.choice(["", self.say("h3", 1, 4, 0, False, False)]) + r.choice([f"<ul>{items(r.randrange(2, 7), 1.0)}</ul>", self.say("p", 5, 50, 0.05), self.words(3, 40)])
        elif kind == "form":
            body = r.choice(["", self.say("p", 3, 20)]) + "".join(self.say("label", 1, 4, 0, False, False) + "<input name=q>" for _ in range(r.randrange(1, 4))) + r.choice(["", "<select><option>" + self.words(1, 3, False) + "<option>" + self.words(1, 3, False) + "</select>"]) + self.say("button", 1, 3, 0, False, False)
        elif kind == "comments":
            one = lambda: r.choice(["<div class='comment'>", "<li>", "<div>", "<article class='comment'>", "<li class='reply'>"])
            body = r.choice(["", self.say("h2", 1, 4, 0, False, False)])
            for _ in range(r.randrange(1, 6)):
                a, z = self.opened(one())
                body += a + r.choice(["", self.say("b", 1, 3, 0, False, False), self.say("span class='author'", 1, 3, 0, False, False)]) + "".join(self.say("p", 2, 60) for _ in range(r.randrange(1, 3))) + z
        else:
            body = r.choice([self.say("p", 3, 45, r.choice([0, 0.1])), self.words(3, 45), self.say("a", 1, 9, 0, False, False), self.say("h3", 1, 6, 0, False, False) + self.say("p", 3, 30)])
            body += self.say("button", 1, 3, 0, False, False) if kind == "notice" and r.random() < 0.4 else ""
        return start + body + end

    def page(self) -> tuple[str, list[str]]:
        r = self.rng
        before = [k for k, p in (("notice", 0.3), ("header", 0.5), ("menu", 0.8), ("form", 0.15), ("advert", 0.4), ("side", 0.2)) if r.random() < p]
        after = [k for k, p in (("share", 0.2), ("comments", 0.3), ("side", 0.35), ("advert", 0.25), ("form", 0.2), ("menu", 0.1), ("footer", 0.8), ("notice", 0.15)) if r.random() < p]
        if r.random() < 0.2:
            r.shuffle(before)
        made = [self.part(k) for k in before] + [self.article()] + [self.part(k) for k in after]
        space = r.choice(["", "\n", "\n  "])
        head = f"<head><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        wrap = self.opened(r.choice(["", "<div class='wrap'>", "<div id='page'>", "<div class='container'>"]))
        return f"<!DOCTYPE html><html>{head}<body>{wrap[0]}" + space.join(made) + wrap[1] + "</body></html>", self.main


def written(n: int, first: int = 0) -> list[tuple[str, list[str]]]:
    return [_Writer(seed).page() for seed in range(first, first + n)]


def sample(spark: SparkSession, n: int) -> DataFrame:
    """html and main of n pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [p for seed in batch.column(0).to_pylist() for p in written(1, seed)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in made], pa.string()), pa.array([m for _, m in made], pa.list_(pa.string()))], ["html", "main"])

    return spark.range(n, numPartitions=8).mapInArrow(run, "html string, main array<string>")
