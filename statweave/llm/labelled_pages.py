"""Labelled pages to train the extraction model on: articles in invented languages, set into site layouts drawn at random, with the main text known by construction."""
from __future__ import annotations

import html
import random
from collections.abc import Iterator

# Names that web pages give to the parts of a layout, and phrases found in them.
NAMES = {
    "article": "article post entry story content body text main copy prose single",
    "menu": "nav menu navbar navigation links topbar breadcrumb breadcrumbs toc pagination pager tabs",
    "header": "header masthead branding logo tagline hero top",
    "footer": "footer colophon copyright legal bottom siteinfo credits",
    "sidebar": "sidebar aside widget rail related popular trending recommended tags categories archive more",
    "notice": "notice cookie cookies consent alert gdpr popup modal overlay paywall banner message toast warning privacy",
    "advert": "ad ads advert advertisement sponsor sponsored promoted promo adsense advertorial commercial",
    "form": "form search login signup contact subscribe newsletter register feedback",
    "comments": "comments comment reply replies discussion disqus respond thread responses commentlist reactions",
    "share": "share social sharing buttons toolbar follow"}
PHRASES = {
    "menu": "Home|About|About us|Contact|News|Blog|Shop|Archive|Sport|Politics|Culture|Start|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Noticias|Help|FAQ|Skip to content|Menu|Next|Previous",
    "footer": "All rights reserved.|Terms of use|Privacy policy|Imprint|Impressum|Datenschutz|Mentions légales|Aviso legal|Sitemap|Powered by|Contact us",
    "sidebar": "Related articles|Popular posts|Most read|Recent posts|Tags|Categories|Trending now|You may also like|Das könnte Sie interessieren|Lire aussi|Más leídas|Recommended for you",
    "notice": "We use cookies to improve your experience.|This site uses cookies.|Accept|Accept all|Decline|Manage settings|Wir verwenden Cookies.|Nous utilisons des cookies.|Usamos cookies.|Subscribe to continue reading.|You have read your last free article.",
    "advert": "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now|Click here|Special offer|Learn more|Promoted content",
    "form": "Search|Email|Your name|Password|Log in|Sign up|Submit|Send|Subscribe|Enter your email|Name|Message|Remember me|Suche|Rechercher|Buscar",
    "comments": "Comments|Leave a comment|Leave a reply|Reply|Report|Log in to comment|Kommentare|Commentaires|Comentarios|Like|Post comment|Anonymous|says:",
    "share": "Share|Tweet|Facebook|Email|Print|Copy link|Teilen|Partager|Compartir|Follow us"}
_AFFIXES = ("site-", "main-", "page-", "post-", "article-", "content-", "l-", "c-", "js-", "block-", "entry-", "global-")
_ENDS = ("-wrapper", "-container", "-inner", "__inner", "-box", "-area", "-section", "-list", "-item", "_1", "-top", "-bottom", "-content", "-text", "-body")
_SYLLABLES = "the ti on er an re in th ed nd st en at or ou es de la le que ción mente os ar un ein sch ich ge ver lich ung é eau eux ment ai ón ñ ra lo pi ma su".split()
_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.main = rng, [], []
        self.semantic, self.named, self.tidy = rng.random(), rng.random() < 0.9, rng.random() < 0.7
        self.site = self.words(rng.randint(1, 2)).title()
        self.noise = rng.choice(("", "", "", "", " |", " |", " ###", "***", "%%%", " →", " ·", " 17", " 2,400", "!!", " ©"))       # junk that the page's prose is full of
        self.dense = rng.choice((0.05, 0.3, 0.9))
        self.shout, self.plain = rng.random() < 0.06, rng.random() < 0.1

    def words(self, n: int) -> str:
        rng = self.rng
        return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3, 4)))) for _ in range(n))

    def sentence(self, n: int | None = None) -> str:
        rng = self.rng
        w = self.words(n or rng.choice((1, 3, 6, 9, 14, 20))).split(" ")
        for i in range(len(w) - 1):
            if rng.random() < 0.07:
                w[i] += ","
            if self.noise and rng.random() < self.dense:
                w[i] += self.noise
        text = " ".join(w)
        return (text.upper() if self.shout else text if self.plain else text.capitalize()) + ("" if self.plain else rng.choice((".",) * 9 + ("!", "?")))

    def prose(self, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def name(self, part: str) -> str:
        """An attribute that names an element, or none."""
        rng = self.rng
        if not self.named and rng.random() < 0.7:
            return rng.choice(("", f' class="css-{rng.randint(1000, 99999)}"', f' class="{self.words(1)}"'))
        names = NAMES[part].split()
        value = rng.choice(names)
        if rng.random() < 0.35:
            value = rng.choice(_AFFIXES) + value
        if rng.random() < 0.3:
            value += rng.choice(_ENDS)
        if rng.random() < 0.2:
            value += " " + rng.choice(names)
        if rng.random() < 0.12:
            value += " " + rng.choice(("row", "col-4", "clearfix", "dark", "large", "u-mt-2", "active"))
        quote = rng.choice('""""\'')
        return f" {rng.choice(('class', 'class', 'class', 'id'))}={quote}{value}{quote}"

    def open(self, part: str, plain: str = "div") -> str:
        """Opens an element for this part and returns its end."""
        semantic = part in _TAGS and self.rng.random() < self.semantic
        tag = _TAGS[part] if semantic else self.rng.choice((plain, plain, "section"))
        self.out.append(f"<{tag}{'' if semantic and self.rng.random() < 0.4 else self.name(part)}>")
        return f"</{tag}>"

    def put(self, tag: str, text: str, main: bool = False, close: bool = True) -> None:
        shown = html.escape(text, quote=self.rng.random() < 0.5)
        if main and self.rng.random() < 0.12 and len(text) > 40:
            w = shown.split(" ")
            k = self.rng.randrange(len(w))
            w[k] = self.rng.choice(('<a href="/{0}">{0}</a>', "<b>{0}</b>", "<em>{0}</em>", "\n  {0}")).format(w[k])
            shown = " ".join(w)
        self.out.append(f"<{tag}>{shown}" + (f"</{tag}>" if close else ""))
        if main:
            self.main.append(" ".join(text.split()))

    def links(self, part: str, n: int) -> None:
        rng = self.rng
        words = PHRASES.get(part, PHRASES["menu"]).split("|")
        style = rng.randrange(3)
        items = [html.escape(rng.choice(words) if rng.random() < 0.4 else self.words(rng.randint(1, 3 if part == "menu" else 9)).capitalize()) for _ in range(n)]
        if style:
            self.out.append("<ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(items)) + "</ul>")
        else:
            self.out.append(rng.choice((" ", " | ", " · ", "")).join(f'<a href="/{i}">{x}</a>' for i, x in enumerate(items)))

    def chatter(self, part: str, n: int) -> None:
        """Words of a part that is not the article: its usual phrases, or sentences much like the article's."""
        for _ in range(n):
            text = self.rng.choice(PHRASES[part].split("|")) if self.rng.random() < 0.4 else self.prose(3)
            tag = self.rng.choice(("p", "p", "div", "span", "", "strong"))
            self.out.append(f"<{tag}>{html.escape(text)}</{tag}>" if tag else html.escape(text))

    def part(self, part: str) -> None:
        rng = self.rng
        if part == "comments":
            return self.comments()
        if part in ("advert", "notice") and rng.random() < 0.25:      # a single named element
            text = rng.choice(PHRASES[part].split("|")) if rng.random() < 0.3 else self.prose(2)
            self.out.append(f"<{(t := rng.choice(('p', 'p', 'div', 'aside')))}{self.name(part)}>{html.escape(text)}</{t}>")
            return None
        end = self.open(part, "ul" if part == "share" and rng.random() < 0.3 else "div")
        if part == "menu":
            self.links(part, rng.randint(2, 9))
        elif part == "header":
            self.out.append(f"<{(t := rng.choice(('h1', 'div', 'p', 'a')))}>{self.site}</{t}>")
            if rng.random() < 0.5:
                self.out.append(f"<p>{self.sentence(5)}</p>")
            if rng.random() < 0.5:
                self.part("menu")
        elif part == "footer":
            if rng.random() < 0.5:
                self.links(part, rng.randint(2, 6))
            sign = rng.choice(("&copy;", "©", "Copyright", "&#169;"))
            self.out.append(rng.choice(("<p>{}</p>", "{}", "<div>{}</div>")).format(f"{sign} {rng.choice(('', '2024 '))}{self.site} {rng.choice(('&middot; ', '- ', '| ', ''))}{html.escape(self.prose(2))}"))
        elif part == "sidebar":
            self.out.append(f"<h{(k := rng.randint(2, 4))}>{rng.choice(PHRASES[part].split('|')) if rng.random() < 0.6 else self.words(2).capitalize()}</h{k}>")
            if rng.random() < 0.75:
                self.links(part, rng.randint(2, 8))
            else:
                self.chatter(part, rng.randint(1, 3))
        elif part == "form":
            for _ in range(rng.randint(1, 4)):
                self.out.append(f"<label>{rng.choice(PHRASES[part].split('|'))}</label><input name='x'>")
            if rng.random() < 0.5:
                self.chatter(part, 1)
            self.out.append(f"<button>{rng.choice(PHRASES[part].split('|'))}</button>")
        elif part == "share":
            self.links(part, rng.randint(2, 5))
        else:
            self.chatter(part, rng.randint(1, 3))
        self.out.append(end)

    def comments(self) -> None:
        rng = self.rng
        end = self.open("comments")
        if rng.random() < 0.7:
            self.out.append(f"<h3>{rng.choice(PHRASES['comments'].split('|'))}</h3>")
        tag = rng.choice(("div", "li", "article", "p", "section"))
        for _ in range(rng.randint(1, 6)):
            self.out.append(f"<{tag}{self.name('comments') if tag != 'p' and rng.random() < 0.8 else ''}>")
            if tag != "p" and rng.random() < 0.6:
                self.out.append(f"<{(t := rng.choice(('span', 'div', 'cite', 'h4')))}>{self.words(1).title()}</{t}> ")
            self.out.append(html.escape(self.prose(4)) if tag == "p" or rng.random() < 0.3 else f"<p>{html.escape(self.prose(4))}</p>")
            if tag != "p" and rng.random() < 0.4:
                self.out.append('<a href="#r">Reply</a>')
            self.out.append(f"</{tag}>")
        if rng.random() < 0.3:
            self.part("form")
        self.out.append(end)

    def article(self, title: str) -> None:
        rng = self.rng
        style = rng.random()
        if style < 0.45:
            opened, end = f"<article{self.name('article') if rng.random() < 0.4 else ''}>", "</article>"
        elif style < 0.6:
            opened, end = "<main>", "</main>"
        elif style < 0.7:
            opened, end = "<main><article>", "</article></main>"
        else:
            tag = rng.choice(("div", "div", "section", "td"))
            opened, end = f"<{tag}{self.name('article')}>", f"</{tag}>"
            if tag == "td":
                opened, end = "<table><tr>" + opened, end + "</tr></table>"
        self.out.append(opened)
        if rng.random() < 0.85:
            self.put(rng.choice(("h1", "h1", "h2")), title, main=True)
        loose, unclosed = rng.random() < 0.12, rng.random() < 0.2
        for k in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = rng.random()
            if k and kind < 0.1:
                self.put(rng.choice(("h2", "h3")), self.words(rng.randint(1, 6)).capitalize(), main=True)
            elif k and kind < 0.17:
                self.out.append("<ul>")
                for _ in range(rng.randint(2, 5)):
                    self.put("li", self.sentence() if rng.random() < 0.6 else self.words(rng.randint(1, 6)), main=True)
                self.out.append("</ul>")
            elif k and kind < 0.21:
                self.out.append("<blockquote>")
                self.put("p", self.prose(3), main=True)
                self.out.append("</blockquote>")
            elif k and kind < 0.23:
                self.put("pre", self.words(12), main=True)
            elif k and kind < 0.25:
                self.out.append('<figure><img src="x.png">')
                self.put("figcaption", self.sentence(), main=True)
                self.out.append("</figure>")
            elif k and kind < 0.40:
                self.part(rng.choice(("advert", "advert", "share", "form", "sidebar", "notice")))
            elif loose:
                self.put("div", self.prose(8), main=True)
            elif rng.random() < 0.12:
                text = self.sentence()
                self.out.append(f"<p><b>{html.escape(text)}<br>")
                self.main.append(text)
            else:
                self.put("p", self.prose(rng.choice((1, 2, 4, 8, 16))), main=True, close=not unclosed)
        self.out.append(end)

    def make(self) -> tuple[str, str]:
        rng = self.rng
        title = (self.sentence(rng.randint(1, 9)) if rng.random() < 0.5 else self.words(rng.randint(1, 9)).capitalize())
        self.out.append(f"<!DOCTYPE html><html><head><title>{html.escape(title + rng.choice(('', '', ' - ' + self.site, ' | ' + self.site)))}</title><style>p{{margin:0}}</style><script>var a=\"</p>\";</script></head>")
        self.out.append("<body" + rng.choice(("", "", ' class="single single-post has-sidebar comments-open"', ' class="home page header-fixed"', ' id="top"')) + ">")
        wraps = []
        for _ in range(rng.choice((0, 0, 1, 2))):
            wraps.append("</div>")
            self.out.append("<div" + rng.choice(("", ' id="page"', ' class="wrapper"', ' class="container"', ' class="layout layout-with-sidebar"', ' class="site"', ' class="main-content"', ' id="content-area"')) + ">")
        before = [p for p, share in (("notice", 0.3), ("header", 0.5), ("menu", 0.7), ("form", 0.1), ("advert", 0.4), ("sidebar", 0.15), ("menu", 0.15), ("share", 0.05)) if rng.random() < share]
        bare = rng.random() < 0.12                                     # a page of the article alone, or nearly so
        if bare:
            before = before[:rng.choice((0, 0, 1))]
        if rng.random() < 0.3:
            rng.shuffle(before)
        for p in before:
            self.part(p)
        if rng.random() < 0.15:
            self.out.append(f'<div{self.name("menu")}><a href="/">Home</a> &rsaquo; <a href="/a">{self.words(1)}</a></div>')
        self.article(title)
        for p, share in (("share", 0.2), ("advert", 0.2), ("comments", 0.45), ("sidebar", 0.4), ("notice", 0.1), ("form", 0.15), ("menu", 0.1)):
            if rng.random() < (0 if bare else share):
                self.part(p)
        if rng.random() < (0.1 if bare else 0.85):
            self.part("footer")
        if rng.random() < 0.1:
            self.part("notice")
        self.out += wraps if self.tidy else []
        if self.tidy:
            self.out.append("</body></html>")
        return ("\n" if rng.random() < 0.4 else "").join(self.out), "\n\n".join(self.main)


def labelled_pages(count: int = 1_800, seed: int = 13) -> Iterator[tuple[str, str]]:
    """Pages and their main texts, always the same for one seed."""
    rng = random.Random(seed)
    for _ in range(count):
        yield _Page(rng).make()
