"""Bodies written to train the block labeller of problem 3. Markup is put into invented text, so what stands in each block is known by construction.

A body is a list of leaves, each with what stands before it, its syntaxes (bits in the order markdown, html, wiki, latex) and its class. Half of what is
inserted are decoys: signs that occur in ordinary text (prices, ranges, file names, comparisons, footnote numbers, apostrophes), and markup inside code.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

MD, HTML, WIKI, LATEX = 1, 2, 4, 8
ALPHABETS = ("abcdefghijklmnoprstuvwyz", "aąbcćdeęghijklłmnoóprsśtuwyzźż", "aäbcdeéfghiklmnoöprstuüßvw", "aàbcdeéèêfghilmnoprstuvçœ", "αβγδεζηθικλμνξοπρστυφχψωάέή", "абвгдеєжзиіїйклмнопрстуфхцчшщью")
ENTITIES = ("&amp;", "&nbsp;", "&lt;", "&gt;", "&quot;", "&#8217;", "&#x2013;", "&ndash;", "&mdash;", "&eacute;", "&#39;", "&hellip;", "&rsquo;", "&ouml;", "&#160;", "&#xE9;", "&laquo;", "&times;")
INLINE = ("b", "i", "em", "strong", "span", "u", "s", "sup", "sub", "a", "mark", "small", "code", "cite", "del", "font", "abbr", "q", "tt", "kbd")
BLOCK = ("p", "div", "section", "article", "blockquote", "center", "ul", "ol", "figure", "td", "header")
COMMANDS = ("textbf", "textit", "emph", "cite", "ref", "footnote", "label", "underline", "texttt", "url", "textsc", "citep", "mbox", "cite[p.~12]")
FORMULAS = ("a^2 + b^2 = c^2", "x_i", "\\alpha + \\beta_{ij} \\le 1", "\\frac{n!}{k!(n-k)!}", "E = mc^2", "\\sum_{i=1}^{n} x_i", "n \\to \\infty", "\\sqrt{a^2 + b^2}", "f(x) = 0", "p < 0.05", "y", "\\int_0^1 t \\, dt", "\\mu", "N = 214", "\\bar{x}_k", "P(A \\mid B)", "R^2", "k+1")
LANGUAGES = ("", "python", "sql", "js", "r", "latex", "html", "text", "bash")


@dataclass
class Leaf:
    before: str
    text: str
    marks: int
    kind: str


@dataclass
class Writer:
    r: random.Random
    alphabet: str
    leaves: list[Leaf] = field(default_factory=list)

    def word(self) -> str:
        w = "".join(self.r.choices(self.alphabet, k=self.r.choice((1, 2, 2, 3, 4, 5, 5, 6, 7, 8, 9, 11))))
        k = self.r.random()
        return w.capitalize() if k < 0.15 else w.upper() if k < 0.17 else w

    def phrase(self, most: int = 4) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, most)))

    def number(self) -> str:
        return str(self.r.choice((self.r.randint(0, 9), self.r.randint(10, 500), self.r.randint(1500, 2030))))

    def decoy(self) -> str:
        """Signs as ordinary text."""
        w, n, r = self.word, self.number, self.r
        return r.choice((
            lambda: f"{n()} * {n()} = {n()}", lambda: f"{n()}*{n()}", lambda: f"{w()}_{w()}_{n()}", lambda: f"{w()}_{n()}_{w()}_v{n()[:1]}.{w()}", lambda: f"from ${n()} to ${n()}", lambda: f"${n()}", lambda: f"US${n()}.50 and ${n()}.00",
            lambda: f"{w()} < {w()} or {w()} > {w()}", lambda: f"{w()[:1]}<{w()[:1]} or {w()[:1]}>{w()[:1]}", lambda: f"{n()} < {n()}", lambda: f"~{n()}.{n()[:1]} or {n()}~{n()}", lambda: "[sic]", lambda: f"[{n()[:2]}]", lambda: f"[{w()}]", lambda: f"[...] {w()}",
            lambda: f"#{n()}", lambda: f"No. #{n()}", lambda: f"{w()} & {w()}", lambda: f"{w()[:1].upper()}&{w()[:1].upper()}", lambda: f"the sign \\ {w()}", lambda: f"C:\\{w()}\\{w()}", lambda: f"{{{w()}, {w()}}}", lambda: f"{w()} = {w()}", lambda: f"{w()} == {w()}", lambda: f"{n()} %",
            lambda: f"pp. {n()}-{n()}", lambda: f"{n()}–{n()}", lambda: f"{w()}'{w()}", lambda: f"'{w()}'", lambda: f"'{w()} {w()}'", lambda: f'"{w()} {w()}"', lambda: f"“{self.phrase()}”", lambda: f"„{self.phrase()}“", lambda: f"«{self.phrase()}»", lambda: f"« {self.phrase()} »", lambda: f"« {self.phrase()} »,", lambda: f"({w()} {w()}, p. {n()})", lambda: f"{w()}’{w()}",
            lambda: f"{w()}@{w()}.org", lambda: f"https://{w()}.org/{w()}", lambda: f"|{w()}|", lambda: f"{n()} | {n()}", lambda: f"{w()}/{w()}", lambda: f"* {w()}", lambda: f"{w()} ** {w()}", lambda: f"^{w()}", lambda: f"{n()}^{n()}", lambda: f"; {w()}", lambda: f": {w()}", lambda: f"{w()} -- {w()}", lambda: f"— {w()} —",
            lambda: f"{n()}’{n()}", lambda: f"f({w()[:1]}, {w()[:1]})", lambda: f"{w()}!", lambda: f"({n()[:1]})", lambda: f"{w()}*", lambda: f"{w()}_", lambda: f"_{w()}", lambda: f"\\{w()[:1]}", lambda: f"{n()}:{n()}", lambda: f"+{n()} {n()}", lambda: f"{w()}…", lambda: f"§ {n()}", lambda: f"<{n()}>", lambda: f"€{n()}, £{n()}", lambda: f"{w()}-{w()}",
            lambda: f"``{w()}''", lambda: f"`{w()}", lambda: f"{w()} {w()}; {w()}", lambda: f"{n()} $", lambda: f"{self.r.choice('CFDJ')}# {w()}", lambda: f"{w()}#", lambda: "[ ]", lambda: f"[ {w()} ]", lambda: f"{w()} [", lambda: f"C++ {w()}", lambda: f"a{n()[:1]} = {{{n()}}}", lambda: f"{w()} \\ {w()}",
        ))()

    def inline(self, deep: bool = True) -> tuple[str, int]:
        """Markup inside a line, and its syntaxes."""
        r, w = self.r, self.phrase
        syntax = r.choice((MD, MD, HTML, HTML, WIKI, WIKI, LATEX, LATEX))
        if syntax == MD:
            mark = r.choice(("*", "**", "***", "_", "__", "~~", "==", "**", "*"))
            made = r.choice((
                lambda: f"{mark}{w()}{mark}", lambda: f"{mark}{w()}{mark}", lambda: f"**{w()} (*{w()}*)**", lambda: f"[{w()}](https://{self.word()}.org/{self.number()})", lambda: f"[{w()}]({self.word()}.md)", lambda: f'[{w()}]({self.word()}/{self.word()} "{w()}")', lambda: f"![{w()}]({self.word()}/{self.word()}.png)",
                lambda: f"[{w()}][{self.number()}]", lambda: f"[{w()}][{self.word()}]", lambda: f"[^{self.number()}]", lambda: f"[^{self.word()}]", lambda: f"<https://{self.word()}.org/{self.word()}>", lambda: f"`{self.code()}`", lambda: f"`{self.code()}`", lambda: f"``{self.word()} ` {self.word()}``", lambda: f"*{w()} **{w()}***",
            ))()
        elif syntax == HTML:
            tag = r.choice(INLINE)
            name = tag.upper() if r.random() < 0.15 else tag
            attr = r.choice(("", "", "", f' class="{self.word()}"', f' href="https://{self.word()}.org"', f" style='color: {self.word()}'", f' data-annotation="%7B{self.number()}%7D"', f" id={self.word()}", f' href=\'https://{self.word()}.org/?q={self.number()}\' title="{self.word()} > {self.word()}"'))
            made = r.choice((
                lambda: f"<{name}{attr}>{w()}</{name}>", lambda: f"<{name}{attr}>{w()}</{name}>", lambda: f"<{name}{attr}>{w()}", lambda: f"{w(2)}</{name}>", lambda: r.choice(ENTITIES), lambda: f"{self.word()}{r.choice(ENTITIES)}{self.word()}", lambda: f"{self.word()}{r.choice(ENTITIES)}{self.word()}", lambda: f"{self.word()}{r.choice(ENTITIES)}{self.word()}",
                lambda: f"&lt;{tag}&gt;{w()}&lt;/{tag}&gt;", lambda: f"&lt;p&gt;{w()}&lt;/p&gt;", lambda: f'<img src="{self.word()}.png" alt="{w()}"/>', lambda: f"<b><i>{w()}</i></b>", lambda: f"<code>{self.code()}</code>", lambda: f"<{name}>{self.code()}</{name}>" if tag in ("code", "tt", "kbd") else f"<{name}>{w()}</{name}>",
            ))()
        elif syntax == WIKI:
            made = r.choice((
                lambda: f"[[{self.target()}]]", lambda: f"[[{self.target()}|{w()}]]", lambda: f"[[{self.target()}]]", lambda: f"[[{self.target()}|{self.target()}]]", lambda: f"[[{self.word()}/{self.word()}.md#{w()}|{w()}]]", lambda: f"[[#{w()}]]", lambda: f"![[{self.word()}/{self.word()}-{self.word()}-{self.word()}.png]]", lambda: f"![[{self.word()}/{w(2)}.png#{self.word()}]]", lambda: f"![[{self.word()} {self.number()}.pdf#{w()}|{w()}]]", lambda: f"[[./{self.word()}/{self.number()} {w()}]]",
                lambda: f"'''{w()}'''", lambda: f"''{w()}''", lambda: f"'''''{w()}'''''", lambda: f"{{{{{w(2)}|{w()}|{self.word()}={self.number()}}}}}", lambda: f"{{{{{w()}}}}}", lambda: f"[https://{self.word()}.example/{self.number()} {w()}]", lambda: f"[[{self.word()}:{w()}]]", lambda: f"''{w()}''", lambda: f"[http://{self.word()}.org {w()}]", lambda: f"{{{{{self.word()}|url=https://{self.word()}.org|title={w()}}}}}",
            ))()
        else:
            made = r.choice((
                lambda: f"${r.choice(FORMULAS)}$", lambda: f"${r.choice(FORMULAS)}$", lambda: f"\\({r.choice(FORMULAS)}\\)", lambda: f"\\({r.choice(FORMULAS)}\\)", lambda: f"\\{r.choice(COMMANDS)}{{{w()}}}", lambda: f"\\{r.choice(COMMANDS)}{{{w()}}}", lambda: f"\\{r.choice(COMMANDS)}{{{self.word()}{self.number()}}}", lambda: f"{{\\it {w()}}}", lambda: f"{{\\bf {w()}}}",
                lambda: f"\\textbf{{\\emph{{{w()}}}}}", lambda: f"${' + '.join(r.choice(FORMULAS) for _ in range(r.randint(2, 20)))}$", lambda: f"\\footnote{{{w(8)}}}", lambda: f"\\cite[p.~{self.number()}]{{{self.word()}{self.number()}}}",
            ))()
        if deep and r.random() < 0.06:
            more, marks = self.inline(False)
            return f"{made} {more}", syntax | marks
        return made, syntax

    def target(self) -> str:
        """What a link names: a title, a path, a key, a heading."""
        r = self.r
        name = r.choice((self.phrase(), self.phrase().upper(), f"@{self.word()}{self.number()}", f"{self.phrase(2)} {self.number()} - {self.phrase(3)}", f"{self.number()} {self.word()}", self.word()))
        return r.choice(("", "", "", "./", "/", f"/{self.word()}/", f"{self.word()}/", f"{self.word()}/{self.word()}/")) + name + r.choice(("", "", "", ".md", f"#{self.phrase()}", f"#^{self.word()}", ".pdf"))

    def code(self) -> str:
        """Inside of code: anything, markup of other syntaxes among it."""
        r, w = self.r, self.word
        return r.choice((f"{w()}", f"{w()} = {w()}", f"[[{w()}]]", f"<{w()}>", f"**{w()}**", f"$x$", f"{w()}_{w()}()", f"\\{w()}", f"'''{w()}'''", f"a & b", f"{{{{{w()}}}}}", f"if x < {self.number()}:", f"#{w()}"))  # noqa: F541

    def sentence(self, marks: list[int], rate: float) -> str:
        r = self.r
        words = [self.word() for _ in range(r.randint(3, 30))]
        words[0] = words[0].capitalize()
        for i in range(len(words) - 1):
            k = r.random()
            if k < 0.06:
                words[i] += ","
            elif k < 0.09:
                words[i] = self.number()
            elif k < 0.10:
                words[i] = r.choice(("—", "–", "(so)", "&c.", ";", ":"))
        while r.random() < 0.3:
            words.insert(r.randint(1, len(words)), self.decoy())
        if r.random() < rate:
            made, bits = self.inline()
            marks[0] |= bits
            at = 0 if r.random() < 0.1 else r.randint(0, len(words))
            words.insert(at, made + r.choice(("", "", "", ",", "’s")))
        if r.random() < 0.1:
            words[-1] = r.choice((f"({self.phrase()} {self.number()} {self.word()} {self.number()})", f"(see {words[-1]}, p. {self.number()})", f"pp. {self.number()}-{self.number()}; {self.phrase()} [{self.word()}]", f"[{self.number()}], {self.phrase()} {{{self.number()}}}, {self.phrase()}"))
        return " ".join(words) + r.choice((".", ".", ".", ".", " ?", "?", "!", ".”", ":", "…", ""))

    def prose(self, rate: float, most: int = 7) -> tuple[str, int]:
        marks = [0]
        out = self.sentence(marks, rate)
        for _ in range(self.r.randint(0, most - 1)):
            out += self.r.choice((" ", " ", " ", " ", "\n", "  \n", "\\\n" if self.r.random() < 0.1 else " ")) + self.sentence(marks, rate)
        return out, marks[0]

    def add(self, text: str, marks: int, kind: str, before: str = "\n\n") -> None:
        self.leaves.append(Leaf(before if self.leaves else "", text, marks, kind))

    # --- blocks -----------------------------------------------------------------------------------------------------------------------------------

    def paragraph(self, rate: float, before: str = "\n\n") -> None:
        if self.r.random() < 0.15:  # a short line, markup first or last or alone
            made, bits = self.inline() if self.r.random() < rate else (self.phrase(3), 0)
            self.add(self.r.choice((made, f"{made} {self.phrase(3)}", f"{self.phrase(3)} {made}.", f"{self.word()} {made} {self.word()}")), bits, "text", before)
        else:
            self.add(*self.prose(rate), "text", before)

    def short(self, rate: float) -> tuple[str, int]:
        if self.r.random() < rate / 2:
            made, bits = self.inline()
            return f"{self.phrase(3)} {made}", bits
        return self.phrase(6), 0

    def md_heading(self, rate: float) -> None:
        text, bits = self.short(rate)
        if self.r.random() < 0.3:
            self.add(f"{text}\n{self.r.choice('=-') * self.r.randint(3, 14)}", MD | bits, "heading")
        else:
            self.add(f"{'#' * self.r.randint(1, 6)} {text}{self.r.choice(('', '', ' ##'))}", MD | bits, "heading")

    def md_list(self, rate: float) -> None:
        mark = self.r.choice(("-", "*", "+", "1.", "1)"))
        for i in range(self.r.randint(1, 6)):
            text, bits = self.prose(rate, 1) if self.r.random() < 0.3 else self.short(rate)
            pad = self.r.choice(("", "", "", "  ", "    ")) if i else ""
            m = f"{i + 1}{mark[1]}" if mark[0] == "1" else mark
            box = self.r.choice(("", "", "", "", "[ ] ", "[x] "))
            if self.r.random() < 0.08:  # a line that goes on without indentation
                more, other = self.prose(rate, 2)
                text, bits = f"{text}\n{more}", bits | other
            self.add(f"{pad}{m} {box}{text}", MD | bits, "list", "\n" if i else "\n\n")

    def md_quote(self, rate: float) -> None:
        lines, marks = [], MD
        for _ in range(self.r.randint(1, 3)):
            text, bits = self.prose(rate, 1)
            lines.append("> " + text.replace("\n", " "))
            marks |= bits
        if self.r.random() < 0.2:
            lines.insert(0, f"> [!{self.word()}] {self.word()}")
        self.add("\n".join(lines), marks, "quote")

    def md_fence(self, rate: float) -> None:
        body = "\n".join(self.r.choice((self.code(), f"  {self.code()}", f"<div class=\"{self.word()}\">", f"{self.word()} = [[{self.word()}]]", "", f"\\section{{{self.word()}}}", f"== {self.word()} ==", f"- {self.word()}", f"$ {self.word()} --{self.word()}")) for _ in range(self.r.randint(1, 6)))
        mark = self.r.choice(("```", "```", "~~~"))
        self.add(f"{mark}{self.r.choice(LANGUAGES)}\n{body}\n{mark}", MD, "code")

    def md_table(self, rate: float) -> None:
        n = self.r.randint(2, 4)
        row = lambda make: "| " + " | ".join(make() for _ in range(n)) + " |"
        lines = [row(lambda: self.phrase(3)), "|" + "|".join(self.r.choice(("---", ":--", "--:", ":--:", "----")) for _ in range(n)) + "|"]
        lines += [row(lambda: self.r.choice((self.phrase(3), self.number()))) for _ in range(self.r.randint(1, 4))]
        self.add("\n".join(lines), MD, "table")

    def md_meta(self, rate: float) -> None:
        if self.r.random() < 0.2:
            self.add("\n".join((self.r.choice(("____", "***", "- - -")), self.prose(0)[0])), MD, "text")
            return
        self.add(self.r.choice(("---", "***", "* * *", "___", f"[{self.number()}]: https://{self.word()}.org/{self.word()}", f'[{self.word()}]: <https://{self.word()}.org> "{self.phrase()}"')), MD, "meta")

    def md_note(self, rate: float) -> None:
        self.add(f"[^{self.number()}]: {self.prose(0)[0]}", MD, "meta")

    def tag(self, name: str, close: bool, before: str) -> None:
        attr = "" if close else self.r.choice(("", "", f' class="{self.word()} {self.word()}"', f' style="margin: {self.number()}px"', f" id='{self.word()}'"))
        self.add(f"<{'/' if close else ''}{name}{attr}>", HTML, "meta", before)

    def html_block(self, rate: float) -> None:
        r = self.r
        name = r.choice(("p", "p", "p", "div", "h1", "h2", "h3", "blockquote", "section", "center"))
        name = name.upper() if r.random() < 0.15 else name
        kind = "heading" if name[0] in "hH" else "quote" if name.lower() == "blockquote" else "text"
        if r.random() < 0.9:
            self.tag(name, False, "\n\n" if r.random() < 0.7 else "\n")
        text, bits = self.short(rate) if kind == "heading" else self.prose(rate)
        self.add(text, bits, kind, "")
        if r.random() < 0.85:
            self.tag(name, True, "")
        if r.random() < 0.1:
            self.add(r.choice(("<br/>", "<br>", "<hr/>", "<BR>")), HTML, "meta", "")

    def html_list(self, rate: float) -> None:
        outer = self.r.choice(("ul", "ol"))
        self.tag(outer, False, "\n\n")
        for _ in range(self.r.randint(1, 4)):
            self.tag("li", False, self.r.choice(("", "\n")))
            text, bits = self.short(rate)
            self.add(text, bits, "list", "")
            if self.r.random() < 0.85:
                self.tag("li", True, "")
        self.tag(outer, True, self.r.choice(("", "\n")))

    def html_table(self, rate: float) -> None:
        self.tag("table", False, "\n\n")
        for _ in range(self.r.randint(1, 3)):
            self.tag("tr", False, "")
            for _ in range(self.r.randint(1, 3)):
                cell = self.r.choice(("td", "td", "th"))
                self.tag(cell, False, "")
                self.add(self.r.choice((self.phrase(3), self.number())), 0, "table", "")
                self.tag(cell, True, "")
            self.tag("tr", True, "")
        self.tag("table", True, "")

    def html_raw(self, rate: float) -> None:
        r = self.r
        if r.random() < 0.4:
            self.add(f"<!-- {self.phrase(6)} -->", HTML, "meta")
        elif r.random() < 0.5:
            tag = r.choice(("script", "style"))
            self.add(f"<{tag}>{r.choice((f'var t = {self.code()};', f'p {{ color: {self.word()} }}'))}</{tag}>", HTML, "meta")
        else:
            self.add(r.choice((f"<pre>{self.code()}\n  {self.code()}</pre>", f"<pre><code>{self.code()}\n{self.code()}</code></pre>", f'<pre class="{self.word()}">{self.code()}</pre>')), HTML, "code")

    def html_open(self, rate: float) -> None:
        """Text with a line break tag at its end, or escaped paragraphs."""
        if self.r.random() < 0.5:
            self.add(f"&lt;p&gt;{self.prose(0)[0]}&lt;/p&gt;", HTML, "text")
        else:
            self.paragraph(rate)
            self.add("<br/>", HTML, "meta", "")

    def wiki_heading(self, rate: float) -> None:
        n = self.r.randint(2, 5)
        self.add(f"{'=' * n} {self.phrase(5)} {'=' * n}" if self.r.random() < 0.8 else f"{'=' * n}{self.phrase(5)}{'=' * n}", WIKI, "heading")

    def wiki_table(self, rate: float) -> None:
        lines = ['{| class="wikitable"' if self.r.random() < 0.7 else "{|"]
        if self.r.random() < 0.6:
            lines.append(f"! {self.phrase()} !! {self.phrase()}")
        for _ in range(self.r.randint(1, 3)):
            lines += ["|-", f"| {self.phrase()} || {self.number()}"]
        self.add("\n".join([*lines, "|}"]), WIKI, "table")

    def wiki_lines(self, rate: float) -> None:
        r = self.r
        if r.random() < 0.4:
            self.add(r.choice((f"; {self.phrase()} : {self.prose(0, 1)[0]}", f";{self.phrase()}\n:{self.prose(0, 1)[0]}", f";{self.phrase()}", f"; {self.phrase()}: {self.phrase()} : {self.phrase(6)}")), WIKI, "list")
        elif r.random() < 0.5:
            for i in range(r.randint(1, 3)):
                self.add(f"{':' * r.randint(1, 3)}{r.choice(('', ' '))}{self.prose(0, 1)[0]}", WIKI, "list", "\n" if i else "\n\n")
        else:
            self.add(r.choice(("__TOC__", "__NOTOC__", f"{{{{{self.phrase(2)}|{self.phrase()}}}}}", f"{{{{{self.phrase(2)}|{self.phrase()}|{self.word()}={self.number()}}}}}", f"[[Category:{self.phrase()}]]", f"[[Kategorie:{self.phrase()}]]", f"[[Kategoria:{self.phrase()}]]", f"[[Catégorie:{self.phrase()}]]")), WIKI, "meta")

    def latex_display(self, rate: float) -> None:
        f = " + ".join(self.r.choice(FORMULAS) for _ in range(self.r.randint(1, 3)))
        env = self.r.choice(("equation", "align", "equation*", "gather"))
        self.add(self.r.choice((f"$${f}$$", f"$$\n{f}\n$$", f"\\[{f}\\]", f"\\[\n{f}\n\\]", f"\\begin{{{env}}}\n{f}\n\\end{{{env}}}")), LATEX, "formula")

    def latex_heading(self, rate: float) -> None:
        self.add(f"\\{self.r.choice(('section', 'subsection', 'section*', 'chapter', 'title', 'subsubsection'))}{{{self.phrase(5)}}}", LATEX, "heading")

    def latex_list(self, rate: float) -> None:
        env = self.r.choice(("itemize", "enumerate"))
        self.add(f"\\begin{{{env}}}", LATEX, "meta")
        for _ in range(self.r.randint(1, 4)):
            text, bits = self.short(rate)
            self.add(f"{self.r.choice(('', '  '))}\\item {text}", LATEX | bits, "list", "\n")
        self.leaves[-1] = Leaf("\n", f"{self.leaves[-1].text}\n\\end{{{env}}}", self.leaves[-1].marks, "list")

    def front(self) -> None:
        lines = [self.r.choice((f"author: {self.word()}", f"title: {self.phrase()}", f"tags:\n  - {self.word()}\n  - {self.word()}", f"aliases: [{self.phrase()}]", f"date: {self.number()}-01-02", f'link: "[[{self.word()}]]"')) for _ in range(self.r.randint(1, 3))]
        self.add("---\n" + "\n".join(lines) + "\n---\n", 0, "meta")

    def unspaced_lists(self, rate: float) -> None:
        """Prose whose lines follow each other without a blank line, one of them a list item."""
        self.paragraph(rate)
        self.add(f"- {self.short(0)[0]}", MD, "list", "\n")


BLOCKS = {
    MD: (Writer.md_heading, Writer.md_heading, Writer.md_list, Writer.md_quote, Writer.md_fence, Writer.md_table, Writer.md_meta, Writer.md_note, Writer.unspaced_lists),
    HTML: (Writer.html_block, Writer.html_block, Writer.html_list, Writer.html_table, Writer.html_raw, Writer.html_open),
    WIKI: (Writer.wiki_heading, Writer.wiki_table, Writer.wiki_lines),
    LATEX: (Writer.latex_display, Writer.latex_display, Writer.latex_heading, Writer.latex_list),
}


def body(r: random.Random) -> list[Leaf]:
    """One body: prose with markup in lines, and blocks of up to four syntaxes."""
    w = Writer(r, r.choice(ALPHABETS))
    own = r.sample((MD, HTML, WIKI, LATEX), r.choice((0, 1, 1, 2, 3)))
    rate = r.choice((0.0, 0.1, 0.3, 0.5))
    if r.random() < 0.2:
        w.front()
    for _ in range(r.choice((1, 1, 2, 2, 3, 4, 5, 6, 8))):
        if own and r.random() < 0.5:
            r.choice(BLOCKS[r.choice(own)])(w, rate)
        else:
            w.paragraph(rate)
    return w.leaves


def text(leaves: list[Leaf]) -> str:
    return "".join(x.before + x.text for x in leaves)
