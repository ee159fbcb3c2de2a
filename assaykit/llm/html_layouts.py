"""Labelled pages to train on: made from a few layouts with invented words, each with the main text that it holds."""

from __future__ import annotations

from random import Random

SYLLABLES = "ba ce di fo gu ha ke li mo nu pa re si to vu wa xe yi zo an el in or us".split()


def pages(number: int, seed: int = 7) -> list[tuple[str, str]]:
    """(html, main text) of so many pages; the same for the same arguments."""
    return [_Maker(Random(seed * 100_003 + i)).page() for i in range(number)]


class _Maker:
    def __init__(self, random: Random):
        self.r, self.main = random, []

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(1, 14).capitalize().replace(" ", self.r.choice([" ", " ", ", "]), 1) + self.r.choice([".", ".", ".", "?", "!"])

    def sentences(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 9])))

    def links(self, item: str = "li") -> str:
        texts = [self.words(1, 3) for _ in range(self.r.randint(2, 7))]
        rows = "".join(f"<{item}><a href='/{t}'>{t}</a></{item}>" if item else f"<a href='/{t}'>{t}</a> | " for t in texts)
        return f"<ul>{rows}</ul>" if item == "li" else rows

    def one_of(self, *options: str) -> str:
        return self.r.choice(options)

    def head(self, title: str) -> str:
        style = "<style>p{margin:0}</style>" if self.r.random() < 0.7 else ""
        return f"<!DOCTYPE html><html><head><title>{title}</title>{style}<script>track('{self.word()}')</script></head><body>"

    def menu(self) -> str:
        links = self.links(self.one_of("li", "li", "", "div"))
        return self.one_of(f"<nav>{links}</nav>", f"<header><nav>{links}</nav></header>", f"<div class='menu'>{links}</div>",
                           f"<div id='navigation'>{links}</div>", f"<header class='header'><p>{self.words(1, 6)}</p>{links}</header>",
                           f"<div class='header'><h1>{self.words(1, 3)}</h1>{links}</div>", f"<div role='navigation'>{links}</div>",
                           f"<header><p>{self.sentence()}</p></header>", f"<div class='breadcrumbs'>{links}</div>", f"<menu>{links}</menu>")

    def notice(self) -> str:
        kind = self.one_of("cookie-notice", "consent", "notice", "alert", "banner", "modal", "popup")
        return self.one_of(f"<div class='{kind}'><p>{self.sentences()}</p><button>{self.words(1, 2)}</button></div>",
                           f"<div class='{kind}'>{self.sentences()}</div>", f"<div role='dialog'>{self.sentences()}</div>",
                           f"<dialog>{self.sentences()}</dialog>", f"<div role='alert'>{self.sentence()}</div>")

    def advert(self) -> str:
        kind = self.one_of("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promoted")
        return self.one_of(f"<div class='{kind}'>{self.sentences()}</div>", f"<aside class='{kind}'><p>{self.sentences()}</p></aside>",
                           f"<div id='{kind}-{self.r.randint(1, 9)}'><a href='/x'>{self.sentence()}</a></div>")

    def sidebar(self) -> str:
        inner = self.one_of(self.links(), f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<p>{self.sentences()}</p>",
                            f"<h4>{self.words(1, 3)}</h4><p>{self.sentences()}</p>")
        kind = self.one_of("sidebar", "widget", "related", "recommended")
        return self.one_of(f"<aside>{inner}</aside>", f"<div class='{kind}'>{inner}</div>", f"<aside class='{kind}'>{inner}</aside>",
                           f"<section class='{kind}'>{inner}</section>")

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name='q'><button>{self.words(1, 2)}</button>"
        kind = self.one_of("newsletter", "login", "search", "signup", "subscribe")
        return self.one_of(f"<form>{inner}</form>", f"<div class='{kind}'><p>{self.sentences()}</p><form>{inner}</form></div>",
                           f"<form class='{kind}'><p>{self.sentence()}</p>{inner}</form>",
                           f"<form><select><option>{self.word()}</option><option>{self.word()}</option></select></form>")

    def comments(self) -> str:
        def one() -> str:
            text = f"<p>{self.sentences()}</p>"
            return self.one_of(text, f"<article class='comment'>{text}</article>", f"<li><b>{self.word()}</b>{text}</li>",
                               f"<div class='comment-body'>{text}</div>", f"<div class='reply'>{self.sentences()}</div>")
        inner = f"<h2>{self.words(1, 2)}</h2>" + "".join(one() for _ in range(self.r.randint(1, 5)))
        kind = self.one_of("comments", "comment-list", "discussion", "responses", "disqus_thread")
        return self.one_of(f"<section class='{kind}'>{inner}</section>", f"<div id='{kind}'>{inner}</div>",
                           f"<div class='{kind}'>{inner}</div>", f"<ol class='{kind}'>{inner}</ol>")

    def footer(self) -> str:
        inner = self.one_of(f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"<p>&copy; {self.words(1, 4)}</p>{self.links('')}",
                            f"<p>{self.sentences()}</p>", self.links())
        return self.one_of(f"<footer>{inner}</footer>", f"<div id='footer'>{inner}</div>", f"<footer class='footer'>{inner}</footer>",
                           f"<div class='copyright'>{inner}</div>")

    def kept(self, text: str) -> str:
        self.main.append(" ".join(text.split()))
        return text

    def linked(self) -> str:
        before, inside, after = self.sentence(), self.words(1, 4), self.words(1, 9)
        self.main.append(f"{before} {inside} {after}.")
        return f"{before} <a href='/x'>{inside}</a> {after}."

    def content(self) -> str:
        title = self.words(2, 9)
        heading = f"<h1>{self.kept(title)}</h1>"
        out = [self.one_of(heading, heading, f"<header>{heading}</header>")]
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 14])):
            kind = self.r.random()
            if kind < 0.5:
                out.append(f"<p>{self.kept(self.sentences())}" + self.one_of("</p>", "</p>", "</p>\n", ""))
            elif kind < 0.58:
                out.append(f"<p>{self.linked()}</p>")
            elif kind < 0.66:
                out.append(f"<h{(k := self.r.randint(2, 4))}>{self.kept(self.words(1, 6))}</h{k}>")
            elif kind < 0.72:
                out.append("<ul>" + "".join(f"<li>{self.kept(self.words(2, 12))}</li>" for _ in range(self.r.randint(1, 4))) + "</ul>")
            elif kind < 0.76:
                out.append(f"<blockquote><p>{self.kept(self.sentences())}</p></blockquote>")
            elif kind < 0.79:
                out.append(f"<figure><img src='/x'><figcaption>{self.kept(self.words(2, 9))}</figcaption></figure>")
            elif kind < 0.82:
                out.append("<table><tr>" + "".join(f"<td>{self.kept(self.words(1, 4))}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.84:
                out.append(f"<pre>{self.kept(self.sentences())}</pre>")
            elif kind < 0.88:
                out.append(f"<p><b>{self.kept(self.sentences())}<br>")
            else:
                out.append(self.one_of(self.advert(), self.sidebar(), self.form(), self.notice(),
                                       f"<div class='share'>{self.links('')}</div>", f"<nav>{self.links()}</nav>"))
        return "\n".join(out)

    def page(self) -> tuple[str, str]:
        before = [self.r.choice([self.menu, self.menu, self.notice, self.advert, self.form])() for _ in range(self.r.randint(1, 4))]
        inner = self.content()
        ends = [self.r.choice([self.comments, self.comments, self.sidebar, self.form, self.advert, self.footer])()
                for _ in range(self.r.randint(0, 3))]
        if self.r.random() < 0.4:
            inner, ends = inner + "".join(f"<footer>{self.words(1, 4)}</footer>" if "footer" in e else e for e in ends), []
        box = self.one_of("article", "article", "main", "div", "div class='content'", "div class='entry-content'", "div id='post-1'",
                          "section class='article-body'", "div class='story-text'", "div role='main'", "div id='main'")
        wrap = self.one_of("{}", "{}", "<main>{}</main>", "<div class='page'>{}</div>", "<div id='wrapper'>{}</div>")
        middle = wrap.format(f"<{box}>{inner}</{box.split()[0]}>" + "".join(ends) + self.one_of("", self.sidebar()))
        text = f"{self.head(self.main[0])}{''.join(before)}{middle}{self.footer()}" + self.one_of("</body></html>", "")
        return text, "\n".join(self.main)
