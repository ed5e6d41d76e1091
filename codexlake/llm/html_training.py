"""Invented pages with known labels, from which the block labeller is trained."""

from __future__ import annotations

import numpy as np

from .html_blocks import Block, Labeller, blocks, inputs

PAGES, SEED = 2400, 17
#: Main text of an invented page starts with this private-use character, which is taken off before training.
_MAIN = "\ue000"

# Names that sites give to parts of a page.
_NAV = ["nav", "menu", "navbar", "navigation", "breadcrumb", "topnav", "links", "toc", "tabs", "pagination", "skip", "language"]
_HEADER = ["header", "masthead", "banner", "branding", "top", "logo", "sitehead", "search", "toolbar"]
_FOOTER = ["footer", "copyright", "bottom", "legal", "colophon", "sitefoot", "imprint"]
_SIDE = ["sidebar", "aside", "widget", "related", "side", "recommended", "popular", "trending", "tags", "share", "social", "author", "newsletter", "teaser"]
_AD = ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "sponsored", "adbox", "commercial", "promotion"]
_NOTICE = ["notice", "cookie", "cookies", "consent", "alert", "gdpr", "popup", "modal", "overlay", "warning", "message", "paywall"]
_COMMENT = ["comments", "comment", "replies", "discussion", "disqus", "responses", "reply", "reader", "feedback", "thread"]
_FORM = ["form", "signup", "subscribe", "login", "contact", "register", "search"]
_BODY = ["article", "content", "post", "entry", "main", "story", "body", "text", "page", "prose", "single", "container", "wrapper"]


# What the parts of a page say, in the words of common sites.
_SAYS = {
    "nav": "Home|About|About us|Contact|News|Blog|Products|Services|Login|Sign in|Menu|Search|Help|FAQ|Shop|Archive|Categories|Next|Previous|Back to top|Skip to content|Startseite|Kontakt|Über uns|Aktuelles|Accueil|Nous contacter|Actualités|Inicio|Contacto|Noticias|Quiénes somos",
    "header": "Welcome to our site|The daily news for everyone|Search this site|Sign in or create an account|Your cart is empty|Willkommen auf unserer Seite|Bienvenue sur notre site|Bienvenido a nuestro sitio",
    "footer": "All rights reserved.|Privacy policy|Terms of use|Terms and conditions|Copyright 2021 by the publisher|Powered by our platform|Imprint|Contact us|Follow us on social media|Made with care|Alle Rechte vorbehalten.|Impressum|Datenschutz|Tous droits réservés.|Mentions légales|Todos los derechos reservados.|Aviso legal",
    "side": "Related articles|Read more|You may also like|Most popular|Recent posts|Tags|Share this|Follow us|About the author|Trending now|Recommended for you|More from this section|Mehr zum Thema|Meistgelesen|À lire aussi|Les plus lus|Te puede interesar|Lo más leído",
    "ad": "Advertisement|Sponsored|Sponsored content|Buy now and save|Limited offer, order today|Free shipping on all orders|Up to 50% off|Click here for the best price|Try it free for 30 days|Anzeige|Jetzt kaufen und sparen|Publicité|Achetez maintenant|Publicidad|Compra ahora",
    "notice": "We use cookies to improve your experience.|By using this site you accept our use of cookies.|Accept all cookies|This site uses cookies, see our privacy policy.|Please enable JavaScript|Your browser is out of date|You have read all your free articles this month, subscribe to continue|Wir verwenden Cookies.|Alle akzeptieren|Ce site utilise des cookies.|Tout accepter|Este sitio utiliza cookies.|Aceptar todo",
    "comment": "Great post, thanks for sharing!|I totally agree with you.|Thanks, this was really helpful.|Reply|Report this comment|Leave a comment|Posted by a reader two hours ago|First!|I don't think this is right at all.|Log in to reply|Could you say more about this?|Danke für den Artikel!|Antworten|Merci pour cet article|Répondre|Gracias por compartir|Responder",
    "form": "Subscribe to our newsletter|Enter your email address|Sign up for updates|Your name|Your message|Send|Submit|Create an account|Forgot your password?|Newsletter abonnieren|Ihre E-Mail-Adresse|Inscrivez-vous à la newsletter|Votre adresse e-mail|Suscríbete al boletín|Tu correo electrónico",
}
_SAYS = {k: v.split("|") for k, v in _SAYS.items()}
#: Small words of running text.
_SMALL = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each how a der die und das von mit den ist auf für nicht ein eine dem sich des le la les et des en un une que pour dans est pas qui sur au el los de y que en las por con una para es al lo como".split()


class _Writer:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.plain = self.bare = False  # of the page at hand: no phrases at all; some parts without telling names
        self.renew()

    def renew(self) -> None:
        """Other words for the next page: main text and unknown sites' other parts share them."""
        letters = list("abcdefghijklmnopqrstuvwxyzéèüöñ")
        own = ["".join(self.rng.choice(letters, self.rng.integers(1, 11))) for _ in range(120)]
        self.words = [w for pair in zip(own[:90], _SMALL, strict=False) for w in pair] + own[90:] if self.maybe(0.6) else own

    def say(self, part: str, lo: int, hi: int) -> str:
        """What a part of the page says: a phrase of such parts, a phrase and other words, or other words alone."""
        if self.plain or (not self.bare and self.maybe(0.35)):
            return self.text(lo, hi)
        phrase = self.one(_SAYS[part])
        return phrase if self.maybe(0.7) or hi < 6 else f"{phrase} {self.text(lo, max(lo + 1, hi // 2))}"

    def one(self, options: list[str]) -> str:
        return options[self.rng.integers(len(options))]

    def maybe(self, p: float) -> bool:
        return self.rng.random() < p

    def text(self, lo: int, hi: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(lo), np.log(hi))))
        words = [self.words[int(k)] for k in (self.rng.random(n) ** 2 * len(self.words))]
        if self.maybe(0.05):  # dull text
            words = [w for w in words[: max(1, n // 12)] for _ in range(12)][:n]
        if self.maybe(0.1):
            words = [w + self.one(["&amp;&amp;", "***", "###", "$$$", "%%%", "!!", " |"]) for w in words]
        return " ".join(words).capitalize() + self.one([".", ".", ".", "", "!", "?"])

    def attributes(self, names: list[str], p: float = 0.8) -> str:
        if not self.maybe(p):
            return ""
        words = [self.one(names) for _ in range(self.rng.integers(1, 3))]
        return f' {self.one(["class", "class", "id"])}="{self.one([" ", "-"]).join(words)}"'

    def links(self, lo: int = 2, hi: int = 9, says: str = "nav") -> str:
        item = lambda: f'<a href="/{self.one(self.words)}">{self.say(says, 1, 4)}</a>'
        n = int(self.rng.integers(lo, hi))
        if self.maybe(0.7):
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return " ".join(item() for _ in range(n))

    def part(self, tags: list[str], names: list[str], inner: str) -> str:
        tag = self.one(tags)
        if self.bare and self.maybe(0.6):  # nothing but its words tells it
            return f"<{(tag := self.one(['div', 'div', 'section', 'p']))}>{inner}</{tag}>"
        return f"<{tag}{self.attributes(names, 1.0 if tag == 'div' else 0.4)}>{inner}</{tag}>"

    def loose(self, lo: int, hi: int, hi_words: int, says: str) -> str:
        n = int(self.rng.integers(lo, hi))
        return "".join(self.one(["<p>{}</p>", "<div>{}</div>", "{} ", "<h3>{}</h3>", "<span>{}</span>"]).format(self.say(says, 1, hi_words)) for _ in range(n))

    def article(self) -> str:
        main = lambda lo, hi: _MAIN + self.text(lo, hi)
        out = [f"<h1>{main(1, 14)}</h1>"] if self.maybe(0.85) else []
        for _ in range(int(self.rng.integers(1, 18))):
            kind = self.rng.random()
            if kind < 0.7:
                out.append(f"<p>{'<b>' if self.maybe(0.1) else ''}{main(1, 160)}{'<br>' if self.maybe(0.1) else ''}" + ("</p>" if self.maybe(0.9) else ""))
            elif kind < 0.78:
                out.append(f"<h{self.rng.integers(2, 5)}>{main(1, 8)}</h2>" if self.maybe(0.1) else f"<h2>{main(1, 8)}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{main(1, 30)}</li>" for _ in range(self.rng.integers(1, 6))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{main(3, 60)}</p></blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{main(1, 6)}</td><td>{main(1, 6)}</td></tr>" for _ in range(self.rng.integers(1, 4))) + "</table>")
            elif kind < 0.93:
                out.append(f"<pre>{main(2, 20)}</pre>")
            elif kind < 0.95:
                out.append(f"<figure><img src=x><figcaption>{main(2, 12)}</figcaption></figure>")
            elif kind < 0.97:
                out.append(self.part(["div", "aside"], _AD, self.loose(1, 3, 25, "ad")))
            else:
                out.append(self.part(["div", "aside"], _SIDE, self.links(1, 5, "side")))
        return "".join(out)

    def page(self) -> str:
        self.plain, self.bare = self.maybe(0.45), False
        self.bare = not self.plain and self.maybe(0.4)
        self.renew()
        top, low = [], []
        if self.maybe(0.6):
            top.append(self.part(["header", "div"], _HEADER, self.loose(1, 4, 8, "header") + (self.links() if self.maybe(0.5) else "")))
        if self.maybe(0.8):
            top.append(self.part(["nav", "nav", "div"], _NAV, self.links()))
        if self.maybe(0.3):
            top.append(self.part(["div", "section", "aside"], _NOTICE, self.loose(1, 3, 40, "notice")))
        if self.maybe(0.5):
            top.append(self.part(["div", "aside", "section"], _AD, self.loose(1, 3, 40, "ad")))
        if self.maybe(0.4):
            (top if self.maybe(0.5) else low).append(self.part(["aside", "div"], _SIDE, self.loose(0, 3, 30, "side") + self.links(says="side")))
        if self.maybe(0.4):
            low.append(self.part(["section", "div", "ol"], _COMMENT, "".join(self.part(["div", "article", "li"], _COMMENT, f"<p>{self.say('comment', 2, 80)}</p>") for _ in range(self.rng.integers(1, 6)))))
        if self.maybe(0.3):
            low.append(self.part(["form", "form", "div"], _FORM, f"<p>{self.say('form', 1, 15)}</p><label>{self.say('form', 1, 4)}</label><input><button>x</button>"))
        if self.maybe(0.2):
            low.append(self.part(["div", "aside"], _AD, self.loose(1, 3, 40, "ad")))
        if self.maybe(0.85):
            low.append(self.part(["footer", "footer", "div"], _FOOTER, "&copy; " * self.maybe(0.6) + self.one(["{}", "<p>{}</p>"]).format(self.say("footer", 1, 40)) + (self.links(says="footer") if self.maybe(0.3) else "")))
        tag = self.one(["article", "article", "main", "div", "div", "section", "body"])
        body = self.article()
        body = body if tag == "body" else f"<{tag}{self.attributes(_BODY, 1.0 if tag in ('div', 'section') else 0.3)}>{body}</{tag}>"
        if self.maybe(0.3):
            body = f"<div{self.attributes(_BODY, 0.5)}>{body}</div>"
        return "<html><head><title>x</title></head><body>" + "".join(top) + body + "".join(low) + "</body></html>"


def labelled(writer: _Writer) -> tuple[list[Block], np.ndarray]:
    """The blocks of an invented page and which of them are main text."""
    page = blocks(writer.page())
    label = np.array([_MAIN in b.text for b in page], np.float32)
    return [Block(b.text.replace(_MAIN, "").strip() or "x", b.path, b.linked, b.depth) for b in page], label


def trained(pages: int = PAGES, seed: int = SEED) -> Labeller:
    writer, rows = _Writer(np.random.default_rng(seed)), []
    for _ in range(pages):
        page, label = labelled(writer)
        if page:
            rows.append((inputs(page), label))
    net = Labeller()
    net.fit(rows)
    return net
