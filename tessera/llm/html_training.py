"""Trains the block labeller: made-up pages with known labels, back-propagation through time, Adam; numpy only.

python -m tessera.llm.html_training writes html_model.npz beside this file.
"""

from __future__ import annotations

import random

import numpy as np

from tessera.llm.html_blocks import blocks
from tessera.llm.html_extraction import HIDDEN, INPUT, MODEL, PATH_DIM, WORD_DIM, Labeller, features, sigmoid

def _names(text: str) -> list[str]:
    return text.split()


# Kinds of elements: tag, then .classes or #id. What stands after "|" is held out: pages of the test sample use it only.
MAIN, HELD_MAIN = (_names(part) for part in (
    "article main div.content div.post div.entry-content div.article-body div#main section.story div.post-content div#content article.post main#main "
    "section.article div.text div.body div.page td.content div.rich-text | div.story-body div.single-entry section.longread article.h-entry div#readable div.copy"
).split("|"))
#: What surrounds main text, by how its inside looks.
AROUND, HELD_AROUND = {}, {}
for _kind, _specs in {
    "links": "nav nav.menu div.nav ul.menu div.navbar div.breadcrumbs div.breadcrumb div.pagination div.related aside.related-posts div.tags div.categories div.social "
    "div.share ul.share-links div#menu nav.toc div.links ul.nav div.site-nav section.recommended div.read-more | div.topbar div.see-also ul.pager nav.crumbs div.keywords",
    "short": "header div.header header.site-header div#header div.logo div.ad div.advert div.advertisement div.banner div.sponsored div.promo aside.ad ins.adsbygoogle div.ads "
    "section.promotion div.cookie div.cookie-notice div.notice div#consent div.alert div.newsletter div.subscribe div.copyright footer div.footer footer.site-footer "
    "div#footer p.copyright div.disclaimer div.legal div.modal div.sponsor | div.gdpr div.popup div.paywall div.masthead div.commercial footer.colophon",
    "prose": "aside aside.sidebar div.sidebar div#sidebar div.widget footer div.about-author div.ad div.advert div.notice div.cookie-banner div.teaser div.promo-box div.disclaimer "
    "| div.side section.teasers aside.rail div.authorbox",
    "form": "form form.search form#login div.form form.newsletter form.comment-form | div.search form.contact form.signup",
    "comments": "div.comments section.comments ol.comment-list div#comments div.comment div.replies section.reader-comments div.responses | ul.discussion div.disqus section#discussion",
}.items():
    AROUND[_kind], HELD_AROUND[_kind] = (_names(part) for part in _specs.split("|"))
LABELS = [
    "Cookie settings", "We use cookies", "Accept all", "Subscribe", "Log in", "Share this", "Leave a reply", "Related articles", "Read more", "Search", "Advertisement",
    "Sponsored", "All rights reserved", "Privacy policy", "Terms", "Contact", "Home", "Sign up for our newsletter", "Follow us", "About us", "Menu", "Imprint", "Impressum",
    "Datenschutz", "Mentions légales", "Aviso legal", "Reply", "Skip to content", "Anzeige", "Publicité", "Publicidad", "Werbung", "Mehr lesen", "Lire la suite", "Leer más",
]
#: Sentences of notices, by kind; a notice in a nondescript element is known by them.
NOTICES = {
    "cookie": [
        "We use cookies to improve your experience on our website", "By continuing to browse you agree to our use of cookies", "You can change your cookie settings at any time",
        "Read our privacy policy to learn how we use your data", "Wir verwenden Cookies, um unsere Website zu verbessern", "Nous utilisons des cookies sur ce site",
        "Utilizamos cookies para mejorar su experiencia", "Our partners store information on your device to show you personalised ads", "Accept all cookies or manage your preferences",
    ],
    "letter": [
        "Subscribe to our newsletter and get the latest news in your inbox", "Sign up today for free and never miss an update", "Enter your email address to subscribe",
        "You can unsubscribe at any time", "Follow us on social media for more stories", "Abonnieren Sie unseren Newsletter", "Abonnez-vous à notre newsletter", "Suscríbase a nuestro boletín",
        "Support our journalism with a subscription from one dollar a week", "Already a subscriber? Log in to read on",
    ],
    "ad": [
        "Advertisement", "Sponsored content by our partner", "Buy now and save up to fifty percent", "Limited offer, free shipping on all orders", "Shop the sale today", "Click here for the best price",
        "Order now and get one free", "This offer ends soon, don't miss out", "Anzeige", "Jetzt kaufen und sparen", "Achetez maintenant", "Compre ahora",
    ],
    "legal": [
        "All rights reserved", "No part of this site may be reproduced without permission", "Terms of use and privacy policy apply", "The views expressed are those of the author", "Alle Rechte vorbehalten",
        "Tous droits réservés", "Todos los derechos reservados", "This site is protected and the terms of service apply",
    ],
}
SYLLABLES = "an the re er on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce ment que ción lich keit ung aux eau".split()
#: Usual words, so that no language's own words tell a notice; what a notice says does.
COMMON = (
    "the of and to in is that it was for on are as with they be at this have from or had by words but what some we can out other were all there when up use your how said an each she "
    "which do their time will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over "
    "know water than call first who may down side been now find any new work part take get place made live where after back little only round man year came show every good "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie "
    "le la les de et un une des en que qui dans pour pas sur plus avec son il elle nous vous mais comme tout être fait "
    "el los las del se por con para una su al lo como más pero sus ya este sí porque esta entre cuando muy sin sobre"
).split()
SCRIPTS = ("абвгдежзиклмнопрстуя", "αβγδεζηικλμνοπρστω", "あいうえおかきくけこさしすせ", "的一是不了人我在有他这中大来上", "אבגדהוזחטיכלמ")


class Maker:
    """Pages of one random style each: (html, label of every block). held: kinds of elements that training never sees."""

    def __init__(self, seed: int, held: bool = False):
        self.r = random.Random(seed)
        self.main_kinds, self.around_kinds = (HELD_MAIN, HELD_AROUND) if held else (MAIN, AROUND)
        self.renamed: dict[str, str] | None = None
        self.alphabet, self.usual = "", 0.0

    def style(self) -> None:
        """A page has elements of telling names, or of made-up ones or none (each name the same all over it); one script in ten isn't Latin."""
        self.renamed = {} if self.r.random() < 0.3 else None
        self.alphabet = self.r.choice(SCRIPTS) if self.r.random() < 0.1 else ""
        self.usual = self.r.choice((0.0, 0.0, 0.3, 0.8, 1.0))

    def words(self, n: int) -> str:
        if self.alphabet:
            return " ".join("".join(self.r.choice(self.alphabet) for _ in range(self.r.randrange(1, 8))) for _ in range(n)).capitalize()
        made = lambda: "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))
        w = [self.r.choice(COMMON) if self.r.random() < self.usual else made() for _ in range(n)]
        return " ".join(w).capitalize()

    def sentence(self) -> str:
        junk = self.r.choice(("", "", "", "", "***", "###", " |")) if self.r.random() < 0.1 else ""
        return ", ".join(self.words(self.r.randrange(2, 9)) for _ in range(self.r.choice((1, 1, 2)))) + junk + self.r.choice(("", ".", ".", ".", "?", "!"))

    def prose(self, least: int = 1, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randrange(least, most)))

    def notice(self) -> str:
        """One to five sentences of a kind, at times with one of made-up words among them."""
        of = self.r.choice(list(NOTICES.values()))
        parts = self.r.sample(of, self.r.randrange(1, 6))
        return ". ".join([*parts, self.words(5)] if self.r.random() < 0.2 else parts) + self.r.choice(("", "."))

    def open(self, spec: str) -> tuple[str, str]:
        name, _, kind = spec.replace("#", ".#").partition(".")
        words = [w for w in kind.split(".") if w]
        ident = [w[1:] for w in words if w.startswith("#")]
        classes = [w for w in words if not w.startswith("#")]
        if self.renamed is not None:
            if kind not in self.renamed:
                made = "".join(self.r.choice("bcdfghjklmnpqrstvwxyz") + self.r.choice("aeiou19") for _ in range(self.r.randrange(1, 4)))
                self.renamed[kind] = made if self.r.random() < 0.6 else ""
            ident, classes = [], [self.renamed[kind]] if self.renamed[kind] else []
        elif classes and self.r.random() < 0.3:
            classes.append(self.r.choice(("clearfix", "col-md-8", "wrap", "inner", "x1", "block", "box", "container")))
        attrs = (f' id="{ident[0]}"' if ident else "") + (f' class="{" ".join(classes)}"' if classes else "")
        return f"<{name}{attrs}>", f"</{name}>"

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randrange(999)}">{text}</a>'

    def label(self) -> str:
        return self.r.choice(LABELS) if self.r.random() < 0.5 else self.words(self.r.randrange(1, 5))

    def around(self, kind: str | None = None) -> str:
        kind = kind or self.r.choices(list(self.around_kinds), (5, 5, 2, 1, 2))[0]
        spec = self.r.choice(self.around_kinds[kind])
        start, end = self.open(spec)
        told = self.renamed is None or spec.split(".")[0].split("#")[0] not in ("div", "section", "p", "ul")  # the element says what it is
        if kind == "links":
            items = [self.link(self.label()) for _ in range(self.r.randrange(2, 9))]
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.6 else " ".join(items)
            body = (f"<h3>{self.label()}</h3>" if self.r.random() < 0.3 else "") + body
        elif kind == "short":
            notice = self.notice()
            wordy = (notice, f"<p>{notice}</p>", f"<p>{notice}</p>{self.link(self.label())}", f"&copy; {self.r.randrange(1990, 2030)} {self.label()}", f"&copy; {self.words(1)}.example.com &middot; {self.sentence()}")
            plain = (self.sentence(), self.label(), f"<p>{self.sentence()}</p>", f"<p>{self.label()}</p>{self.link(self.label())}", self.prose(1, 4))
            titles = (f"<h2>{self.words(3)}</h2>", f"<h1>{self.words(2)}</h1>") if spec.startswith("header") else (f"<h2>{self.words(3)}</h2>",)
            body = self.r.choice((*wordy, *plain, *titles) if told else wordy)
        elif kind == "prose":
            head = f"<h3>{self.r.choice(LABELS)}</h3>" if not told or self.r.random() < 0.3 else f"<h3>{self.words(3)}</h3>" if self.r.random() < 0.3 else ""
            one = lambda: self.prose() if told and self.r.random() < 0.6 else self.notice()
            body = head + "".join(f"<p>{one()}</p>" for _ in range(self.r.randrange(1, 5)))
        elif kind == "form":
            body = f"<label>{self.label()}</label><input name=q><p>{self.sentence()}</p><button>{self.label()}</button>"
        else:
            item = self.r.choice(("li", "div.comment", "article.comment", "div"))
            one = lambda: "{}<b>{}</b><p>{}</p>{}".format(self.open(item)[0], self.words(2), self.prose(), self.open(item)[1])
            count = self.r.randrange(1, 7)
            title = self.r.choice((f"{count} comments", "Comments", "Leave a reply", f"{count} Kommentare", "Commentaires", "Comentarios", "Join the discussion", "Reader responses"))
            body = (f"<h2>{title}</h2>" if not told or self.r.random() < 0.7 else "") + "".join(one() for _ in range(count))
        return start + body + end

    def main(self) -> str:
        out = [f"<h1>{self.words(self.r.randrange(2, 14))}</h1>"] if self.r.random() < 0.9 else []
        for _ in range(self.r.choice((1, 2, 3, 5, 8, 12, 20))):
            x = self.r.random()
            if x < 0.72:
                text = self.prose(1, self.r.choice((3, 9, 9, 9, 40))) if self.r.random() < 0.8 else self.words(self.r.randrange(1, 4)) + "."
                text = text.replace(" ", f" {self.link(self.words(1))} ", 1) if self.r.random() < 0.15 else text
                out.append(f"<p><b>{text}<br>" if self.r.random() < 0.08 else f"<p>{text}" if self.r.random() < 0.05 else f"<p>{text}</p>")
            elif x < 0.8:
                out.append(f"<h{self.r.choice('234')}>{self.words(self.r.randrange(1, 6))}</h2>")
            elif x < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randrange(2, 6))) + "</ul>")
            elif x < 0.91:
                out.append(f"<blockquote>{self.prose(1, 3)}</blockquote>")
            elif x < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr>" for _ in range(2)) + "</table>")
            elif x < 0.97:
                out.append(f"<div>{self.prose()}</div>")
            else:
                out.append(f"<pre>{self.words(5)}</pre>")
        return "".join(out)

    def page(self) -> tuple[str, list[int]]:
        """The page and the label of each of its blocks; main blocks are marked by a character that is then taken out."""
        self.style()
        mark = "\u2063"
        start, end = self.open(self.r.choice(self.main_kinds))
        body = self.main()
        for tag in ("<p>", "<b>", "<li>", "<td>", "<h1>", "<h2>", "<h3>", "<h4>", "<blockquote>", "<div>", "<pre>"):
            body = body.replace(tag, tag + mark)
        if self.r.random() < 0.3:
            at = body.find("<p>", len(body) // 2)
            body = body[:at] + self.around() + body[at:] if at > 0 and "<b>" not in body else body
        main = start + body + (self.around() if self.r.random() < 0.25 else "") + end
        before = "".join(self.around() for _ in range(self.r.randrange(0, 4)))
        after = "".join(self.around() for _ in range(self.r.randrange(0, 5)))
        if self.r.random() < 0.3:
            wrap, close = self.open(self.r.choice(("div.container", "div#page", "div.wrapper", "div#wrap", "div.layout", "div.row")))
            main = wrap + (self.around() if self.r.random() < 0.5 else "") + main + (self.around() if self.r.random() < 0.5 else "") + close
        head = f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style></head>"
        page = f"{head}<body>{before}<!-- x -->{main}{after}<script>t('<p>')</script></body></html>"
        found = blocks(page)
        labels = [int(mark in b.text) for b in found]
        return page.replace(mark, ""), labels


def sample(seed: int, n: int, held: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    maker, out = Maker(seed, held), []
    while len(out) < n:
        page, labels = maker.page()
        found = blocks(page)
        if found and len(found) == len(labels):
            out.append((features(found), np.array(labels, np.float32)))
    return out


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"w{d}"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN)).astype(np.float32)
        p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        p[f"b{d}"] = np.zeros(4 * HIDDEN, np.float32)
        p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
    p["o"], p["c"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)
    return p


def gradient(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over blocks, and its gradient by back-propagation through time in both directions."""
    n, steps, hidden = x.shape[0], x.shape[1], HIDDEN
    kept, outs = {}, {}
    for d in "fb":
        h, c, trail = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32), []
        out = np.zeros((n, steps, hidden), np.float32)
        inputs = x @ p[f"w{d}"] + p[f"b{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[:, t] + h @ p[f"u{d}"]
            gates, g = sigmoid(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            fresh = f * c + i * g
            tanh, m = np.tanh(fresh), mask[:, t, None]
            trail.append((t, h, c, i, f, o, g, tanh, m))
            h, c = m * (o * tanh) + (1 - m) * h, m * fresh + (1 - m) * c
            out[:, t] = h
        kept[d], outs[d] = trail, out
    both = np.concatenate([outs["f"], outs["b"]], axis=2)
    z = both @ p["o"] + p["c"]
    prob, total = sigmoid(z), mask.sum()
    loss = float(-(mask * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / total)
    dz = mask * (prob - y) / total
    grad = {"o": np.einsum("nt,ntk->k", dz, both), "c": np.array([dz.sum()], np.float32)}
    for k, d in enumerate("fb"):
        dout = dz[:, :, None] * p["o"][k * hidden : (k + 1) * hidden]
        dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        dinputs = np.zeros((n, steps, 4 * hidden), np.float32)
        du = np.zeros_like(p[f"u{d}"])
        for t, h, c, i, f, o, g, tanh, m in reversed(kept[d]):
            dh = dh + dout[:, t]
            inner = m * dh
            dfresh = m * dc + inner * o * (1 - tanh * tanh)
            step = np.concatenate([dfresh * g * i * (1 - i), dfresh * c * f * (1 - f), inner * tanh * o * (1 - o), dfresh * i * (1 - g * g)], axis=1)
            du += h.T @ step
            dinputs[:, t] = step
            dh = (1 - m) * dh + step @ p[f"u{d}"].T
            dc = (1 - m) * dc + dfresh * f
        grad[f"u{d}"] = du
        grad[f"w{d}"] = x.reshape(-1, x.shape[2]).T @ dinputs.reshape(-1, 4 * hidden)
        grad[f"b{d}"] = dinputs.sum((0, 1))
    return loss, grad


def train(pages: int = 24000, epochs: int = 14, batch: int = 48, rate: float = 0.004, seed: int = 1) -> Labeller:
    data, p = sample(seed, pages), initial(seed)
    rng = np.random.default_rng(seed)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    by_size = sorted(range(len(data)), key=lambda i: len(data[i][1]))
    batches = [by_size[i : i + batch] for i in range(0, len(by_size), batch)]
    for epoch in range(epochs):
        losses = []
        for k in rng.permutation(len(batches)):
            mine = [data[i] for i in batches[k]]
            most = max(len(y) for _, y in mine)
            x, mask, y = np.zeros((len(mine), most, INPUT), np.float32), np.zeros((len(mine), most), np.float32), np.zeros((len(mine), most), np.float32)
            for i, (f, labels) in enumerate(mine):
                x[i, : len(labels)], mask[i, : len(labels)], y[i, : len(labels)] = f, 1, labels
            x *= rng.random(x.shape) > 0.05  # some features missing
            x[:, :, PATH_DIM : PATH_DIM + WORD_DIM] *= rng.random((*x.shape[:2], 1)) > 0.2  # and all words of some blocks
            loss, grad = gradient(p, x, mask, y)
            losses.append(loss)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            pace = rate * (1 - epoch / epochs)
            for key, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m1[key], m2[key] = 0.9 * m1[key] + 0.1 * g, 0.999 * m2[key] + 0.001 * g * g
                p[key] = p[key] - pace * (m1[key] / (1 - 0.9**step)) / (np.sqrt(m2[key] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch + 1}: loss {np.mean(losses):.4f}", flush=True)
    return Labeller({k: v.astype(np.float32) for k, v in p.items()})


def accuracy(model: Labeller, seed: int, n: int = 500, held: bool = True) -> float:
    """Share of blocks judged right, on pages whose kinds of elements training never sees."""
    right = total = 0
    for f, y in sample(seed, n, held):
        right += int(((model.scores([f])[0] > 0) == (y > 0.5)).sum())
        total += len(y)
    return right / total


if __name__ == "__main__":
    trained = train()
    print("accuracy by kinds held out", accuracy(trained, 999), "by kinds known", accuracy(trained, 999, held=False))
    np.savez_compressed(MODEL, **{k: v.astype(np.float16) for k, v in trained.p.items()})
