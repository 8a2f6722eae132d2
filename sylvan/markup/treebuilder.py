"""Tree construction of the WHATWG HTML standard, with scripting off."""

from __future__ import annotations

from sylvan.markup.dom import HTML, MATH, SVG, Document, Node
from sylvan.markup.tokenizer import USUAL, USUAL_PAIR, Tokenizer

#: Fixed by the standard: sets of element names.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
SPECIAL = set(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt "
    "embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link "
    "listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style "
    "summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
CLOSED_BLOCKS = BLOCKS - {"p"} | {"button", "listing", "pre"}
IMPLIED = {"dd", "dt", "li", "optgroup", "option", "p", "rb", "rp", "rt", "rtc"}
IMPLIED_ALL = IMPLIED | {"caption", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements whose end tag, where they are the current node, does nothing but close them.
PLAIN_ENDS = CLOSED_BLOCKS | HEADINGS | {"p", "li", "dd", "dt"}
VOID_IN_BODY = {"area", "br", "embed", "img", "keygen", "wbr"}
HEAD_ONLY = {"base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"}
SCOPE = {(HTML, t) for t in "applet caption html table td th marquee object template select".split()} - {(HTML, "select")}
SCOPE |= {(MATH, t) for t in ("mi", "mo", "mn", "ms", "mtext", "annotation-xml")} | {(SVG, t) for t in ("foreignObject", "desc", "title")}
LIST_SCOPE, BUTTON_SCOPE = SCOPE | {(HTML, "ol"), (HTML, "ul")}, SCOPE | {(HTML, "button")}
TABLE_SCOPE = {(HTML, "html"), (HTML, "table"), (HTML, "template")}
MATH_TEXT = {"mi", "mo", "mn", "ms", "mtext"}
SVG_HTML = {"foreignObject", "desc", "title"}
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
SVG_TAGS = {
    t.lower(): t
    for t in "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer "
    "feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR "
    "feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence "
    "foreignObject glyphRef linearGradient radialGradient textPath".split()
}
SVG_ATTRS = {
    t.lower(): t
    for t in "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef "
    "gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight "
    "markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX "
    "pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures "
    "specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX "
    "targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan".split()
}
FOREIGN_ATTRS = {f"xlink:{n}": ("xlink", "xlink", n) for n in "actuate arcrole href role show title type".split()}
FOREIGN_ATTRS |= {"xml:lang": ("xml", "xml", "lang"), "xml:space": ("xml", "xml", "space"), "xmlns": ("xmlns", None, "xmlns"), "xmlns:xlink": ("xmlns", "xmlns", "xlink")}
#: Fixed by the standard: public identifiers, or their beginnings, that mean quirks.
QUIRKS_IDS = {"-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html"}
QUIRKS_STARTS = (
    "+//silmaril//dtd html pro v0r11 19970101//", "-//as//dtd html 3.0 aswedit + extensions//", "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html", "-//metrius//dtd metrius presentational//", "-//microsoft//dtd internet explorer", "-//netscape comm. corp.//dtd",
    "-//o'reilly and associates//dtd html", "-//sq//dtd html 2.0 hotmetal + extensions//", "-//softquad", "-//spyglass//dtd html 2.0 extended//",
    "-//sun microsystems corp.//dtd hotjava", "-//w3c//dtd html 3", "-//w3c//dtd html 4.0 frameset//", "-//w3c//dtd html 4.0 transitional//",
    "-//w3c//dtd html experimental", "-//w3c//dtd w3 html 3.0//", "-//w3o//dtd w3 html 3.0//", "-//webtechs//dtd mozilla html",
)
LIMITED_STARTS = ("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//")
HTML_401 = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
WHITE = "\t\n\f\r "


def quirks_mode(name: str | None, public: str | None, system: str | None, forced: bool) -> str:
    p, s = (public or "").lower(), (system or "").lower()
    if forced or name != "html" or p in QUIRKS_IDS or p.startswith(QUIRKS_STARTS) or s == "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd" or system is None and p.startswith(HTML_401):
        return "quirks"
    return "limited-quirks" if p.startswith(LIMITED_STARTS) or system is not None and p.startswith(HTML_401) else "no-quirks"


class Builder:
    def __init__(self, text: str, fragment: bool):
        self.tokens = Tokenizer(text)
        self.doc = Document(Node(0, "fragment" if fragment else "document"))
        self.doc.errors = self.tokens.errors
        self.open: list[Node] = []
        self.active: list[Node | None] = []  # None is a marker
        self.templates: list[str] = []
        self.head = self.form = None
        self.context = None
        self.frames_ok, self.foster, self.skip_lf = True, False, False
        self.mode = self.back = "initial"
        self.table_text: list[str] = []
        if fragment:
            self.context = self.doc.new("element", tag="body", ns=HTML)
            root = self.doc.new("element", tag="html", ns=HTML)
            self.doc.root.append(root)
            self.open.append(root)
            self.mode = "in_body"

    def usual(self) -> None:
        """The tokens ahead that only open a block or list item, close the current node or add text, as the rules for `in_body` have it.

        Stops at the first that may do anything else: open paragraphs, formatting elements, references, other tags.
        """
        tokens, stack, doc = self.tokens, self.open, self.doc
        text, at, n = tokens.text, tokens.at, len(tokens.text)
        match, top = USUAL.match, stack[-1]
        paragraph = any(x.tag == "p" for x in stack)
        while top.ns == HTML and top.template is None and (m := match(text, at)):
            data, slash, tag, pairs = m.groups()
            if data is not None:
                end = m.end()
                if end < n and text[end] != "<":
                    break
                own = top.children
                if own and own[-1].kind == "text":
                    own[-1].text += data
                else:
                    top.append(Node(doc.size, "text", text=data))
                    doc.size += 1
                if self.frames_ok and data.strip(WHITE):
                    self.frames_ok = False
                at = end
                continue
            if slash:
                if tag != top.tag or tag not in PLAIN_ENDS or pairs:
                    break
                stack.pop()
                at, top = m.end(), stack[-1]
                paragraph = paragraph and any(x.tag == "p" for x in stack)
                continue
            if paragraph or not (tag in BLOCKS or tag == "li" and top.tag in ("ul", "ol")):
                break
            attrs = [[None, None, k, v] for k, v in USUAL_PAIR.findall(pairs)] if pairs else []
            if len(attrs) > 1 and len({a[2] for a in attrs}) < len(attrs):
                break
            node = Node(doc.size, "element", tag, HTML, attrs)
            doc.size += 1
            top.append(node)
            stack.append(node)
            if tag == "li":
                self.frames_ok = False
            at, top, paragraph, tokens.last = m.end(), node, tag == "p", tag
        tokens.at = at

    def run(self) -> Document:
        while True:
            if self.mode == "in_body" and not self.active and not self.skip_lf and not self.foster and self.tokens.mode == "data":
                self.usual()
            top = self.open[-1] if self.open else None
            token = self.tokens.next(top is not None and top.ns != HTML)
            kind = token[0]
            if kind == "text" and self.skip_lf and token[1].startswith("\n"):
                token = ("text", token[1][1:])
            self.skip_lf = False
            if kind != "text" or token[1]:
                self.dispatch(token)
            if kind == "eof":
                return self.doc

    # -- where a token goes --

    def dispatch(self, token: tuple) -> None:
        """By the rules of the insertion mode, or of foreign content."""
        while token is not None:
            token = self.foreign(token) if self.is_foreign(token) else getattr(self, self.mode)(token)

    def is_foreign(self, token: tuple) -> bool:
        if not self.open or token[0] == "eof":
            return False
        node = self.open[-1]
        if node.ns == HTML:
            return False
        if node.ns == MATH and node.tag in MATH_TEXT and (token[0] == "text" or token[0] == "start" and token[1] not in ("mglyph", "malignmark")):
            return False
        if node.ns == MATH and node.tag == "annotation-xml" and token[0] == "start" and token[1] == "svg":
            return False
        return not (self.html_point(node) and token[0] in ("start", "text"))

    @staticmethod
    def html_point(node: Node) -> bool:
        return node.ns == SVG and node.tag in SVG_HTML or node.math_ip

    def error(self, what: str) -> None:
        self.doc.errors.append(what)

    # -- stack of open elements --

    def has(self, tags, scope=SCOPE) -> bool:
        tags = {tags} if isinstance(tags, str) else tags
        for node in reversed(self.open):
            if node.ns == HTML and node.tag in tags:
                return True
            if (node.ns, node.tag) in scope:
                return False
        return False

    def is_open(self, tag: str) -> bool:
        return any(n.tag == tag and n.ns == HTML for n in self.open)

    def pop_to(self, tags) -> None:
        tags = {tags} if isinstance(tags, str) else tags
        while self.open:
            node = self.open.pop()
            if node.ns == HTML and node.tag in tags:
                return

    def clear_to(self, tags: set) -> None:
        while self.open[-1].tag not in tags | {"template", "html"} or self.open[-1].ns != HTML:
            self.open.pop()

    def implied(self, but: str | None = None, among: set = IMPLIED) -> None:
        while self.open[-1].ns == HTML and self.open[-1].tag in among and self.open[-1].tag != but:
            self.open.pop()

    def close_p(self) -> None:
        self.implied("p")
        self.pop_to("p")

    def close_p_in_button(self) -> None:
        if self.has("p", BUTTON_SCOPE):
            self.close_p()

    # -- insertion --

    def place(self, target: Node | None = None) -> tuple[Node, Node | None]:
        """Where a node goes: its parent, and the child that it goes before."""
        target = target or self.open[-1]
        if self.foster and target.ns == HTML and target.tag in {"table", "tbody", "tfoot", "thead", "tr"}:
            last = {n.tag: i for i, n in enumerate(self.open) if n.ns == HTML and n.tag in ("template", "table")}
            table, template = last.get("table", -1), last.get("template", -1)
            if template > table:
                return self.open[template].template, None
            if table < 0:
                return self.open[0], None
            node = self.open[table]
            return (node.parent, node) if node.parent is not None else (self.open[table - 1], None)
        return (target.template, None) if target.template is not None else (target, None)

    def put(self, node: Node, where: tuple[Node, Node | None]) -> None:
        parent, before = where
        if before is None:
            parent.append(node)
        else:
            parent.insert(node, before)

    def text(self, data: str) -> None:
        parent, before = self.place()
        if parent.kind == "document" or not data:
            return
        own = parent.children
        last = own[own.index(before) - 1] if before is not None and own.index(before) else own[-1] if before is None and own else None
        if last is not None and last.kind == "text":
            last.text += data
        else:
            self.put(self.doc.new("text", text=data), (parent, before))

    def comment(self, data: str, parent: Node | None = None) -> None:
        node = self.doc.new("comment", text=data)
        self.put(node, (parent, None) if parent is not None else self.place())

    def element(self, tag: str, attrs=(), ns: str = HTML) -> Node:
        made = [list(FOREIGN_ATTRS[k]) + [v] if ns != HTML and k in FOREIGN_ATTRS else [None, None, k, v] for k, v in attrs]
        node = self.doc.new("element", tag=tag, ns=ns, attrs=made)
        if ns == HTML and tag == "template":
            node.template = self.doc.new("fragment")
        if ns == MATH and tag == "annotation-xml":
            node.math_ip = any(k == "encoding" and v.lower() in ("text/html", "application/xhtml+xml") for k, v in attrs)
        return node

    def insert(self, tag: str, attrs=(), ns: str = HTML) -> Node:
        node = self.element(tag, attrs, ns)
        self.put(node, self.place())
        self.open.append(node)
        return node

    def insert_void(self, tag: str, attrs=()) -> None:
        self.insert(tag, attrs)
        self.open.pop()

    def merge(self, node: Node, attrs) -> None:
        own = {a[2] for a in node.attrs}
        node.attrs += [[None, None, k, v] for k, v in attrs if k not in own]

    def raw(self, token: tuple, mode: str) -> None:
        self.insert(token[1], token[2])
        self.tokens.mode, self.tokens.last = mode, token[1]
        self.back, self.mode = self.mode, "in_text"

    # -- active formatting elements --

    def push_active(self, node: Node) -> None:
        """At most three alike since the last marker."""
        alike = []
        for i in range(len(self.active) - 1, -1, -1):
            other = self.active[i]
            if other is None:
                break
            if other.tag == node.tag and other.ns == node.ns and sorted(map(str, other.attrs)) == sorted(map(str, node.attrs)):
                alike.append(i)
        if len(alike) >= 3:
            del self.active[alike[-1]]
        self.active.append(node)

    def reconstruct(self) -> None:
        active = self.active
        if not active or active[-1] is None or active[-1] in self.open:
            return
        i = len(active) - 1
        while i > 0 and active[i - 1] is not None and active[i - 1] not in self.open:
            i -= 1
        for i in range(i, len(active)):
            old = active[i]
            active[i] = self.insert(old.tag, [(a[2], a[3]) for a in old.attrs])

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> bool:
        """The adoption agency. False: act as for any other end tag."""
        top = self.open[-1]
        if top.ns == HTML and top.tag == tag and top not in self.active:
            self.open.pop()
            return True
        for _ in range(8):
            node = None
            for other in reversed(self.active):
                if other is None:
                    break
                if other.tag == tag:
                    node = other
                    break
            if node is None:
                return False
            if node not in self.open:
                self.error("formatting element not open")
                self.active.remove(node)
                return True
            at = self.open.index(node)
            scoped = True
            for other in reversed(self.open):
                if other is node:
                    break
                if (other.ns, other.tag) in SCOPE:
                    scoped = False
                    break
            if not scoped:
                self.error("formatting element not in scope")
                return True
            block = next((n for n in self.open[at + 1 :] if self.special(n)), None)
            if block is None:
                del self.open[at:]
                self.active.remove(node)
                return True
            ancestor, mark = self.open[at - 1], self.active.index(node)
            last, i, count = block, self.open.index(block), 0
            while True:
                count += 1
                i -= 1
                other = self.open[i]
                if other is node:
                    break
                if count > 3 and other in self.active:
                    k = self.active.index(other)
                    del self.active[k]
                    mark -= k < mark
                if other not in self.active:
                    del self.open[i]
                    continue
                copy = self.element(other.tag, [(a[2], a[3]) for a in other.attrs])
                self.active[self.active.index(other)] = copy
                self.open[i] = copy
                if last is block:
                    mark = self.active.index(copy) + 1
                last.detach()
                copy.append(last)
                last = copy
            last.detach()
            self.put(last, self.place(ancestor))
            copy = self.element(node.tag, [(a[2], a[3]) for a in node.attrs])
            for child in block.children[:]:
                child.parent = copy
            copy.children, block.children = block.children, []
            block.append(copy)
            k = self.active.index(node)
            del self.active[k]
            mark -= k < mark
            self.active.insert(mark, copy)
            self.open.remove(node)
            self.open.insert(self.open.index(block) + 1, copy)
        return True

    @staticmethod
    def special(n: Node) -> bool:
        return n.tag in SPECIAL if n.ns == HTML else n.tag in MATH_TEXT | {"annotation-xml"} if n.ns == MATH else n.tag in SVG_HTML

    def reset(self) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node, last = self.open[i], i == 0
            if last and self.context is not None:
                node = self.context
            if node.ns == HTML:
                modes = {"tr": "in_row", "tbody": "in_body_rows", "thead": "in_body_rows", "tfoot": "in_body_rows", "caption": "in_caption", "colgroup": "in_columns", "table": "in_table", "body": "in_body", "frameset": "in_frameset"}
                if node.tag == "select":
                    above = [n.tag for n in self.open[:i]]
                    self.mode = "in_select_in_table" if "table" in above and "template" not in above[len(above) - 1 - above[::-1].index("table") :] else "in_select"
                    return
                if node.tag in ("td", "th") and not last:
                    self.mode = "in_cell"
                    return
                if node.tag == "head" and not last:
                    self.mode = "in_head"
                    return
                if node.tag == "template":
                    self.mode = self.templates[-1]
                    return
                if node.tag == "html":
                    self.mode = "before_head" if self.head is None else "after_head"
                    return
                if node.tag in modes:
                    self.mode = modes[node.tag]
                    return
            if last:
                self.mode = "in_body"

    # -- insertion modes: each returns a token to be dispatched again, or None --

    @staticmethod
    def lead(token: tuple) -> tuple[str, tuple | None]:
        """Leading white space of a text token, and the rest as a token."""
        rest = token[1].lstrip(WHITE)
        return token[1][: len(token[1]) - len(rest)], ("text", rest) if rest else None

    def initial(self, token: tuple):
        if token[0] == "text":
            token = self.lead(token)[1]
            if token is None:
                return None
        elif token[0] == "comment":
            return self.comment(token[1], self.doc.root)
        elif token[0] == "doctype":
            node = self.doc.new("doctype", tag=token[1] or "")
            node.public, node.system = token[2] or "", token[3] or ""
            self.doc.root.append(node)
            self.doc.quirks, self.mode = quirks_mode(*token[1:]), "before_html"
            return None
        self.error("missing doctype")
        self.doc.quirks, self.mode = "quirks", "before_html"
        return token

    def root_element(self, attrs=()) -> None:
        node = self.element("html", attrs)
        self.doc.root.append(node)
        self.open.append(node)
        self.mode = "before_head"

    def before_html(self, token: tuple):
        kind = token[0]
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "comment":
            return self.comment(token[1], self.doc.root)
        if kind == "text":
            token = self.lead(token)[1]
            if token is None:
                return None
        if kind == "start" and token[1] == "html":
            return self.root_element(token[2])
        if kind == "end" and token[1] not in ("head", "body", "html", "br"):
            return self.error("unexpected end tag")
        self.root_element()
        return token

    def before_head(self, token: tuple):
        kind = token[0]
        if kind == "text":
            token = self.lead(token)[1]
            if token is None:
                return None
        if kind == "comment":
            return self.comment(token[1])
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "start" and token[1] == "html":
            return self.in_body(token)
        if kind == "start" and token[1] == "head":
            self.head, self.mode = self.insert("head", token[2]), "in_head"
            return None
        if kind == "end" and token[1] not in ("head", "body", "html", "br"):
            return self.error("unexpected end tag")
        self.head, self.mode = self.insert("head"), "in_head"
        return token

    def in_head(self, token: tuple):
        kind = token[0]
        if kind == "text":
            white, token = self.lead(token)
            self.text(white)
            if token is None:
                return None
        if kind == "comment":
            return self.comment(token[1])
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "start":
            tag = token[1]
            if tag == "html":
                return self.in_body(token)
            if tag in ("base", "basefont", "bgsound", "link", "meta"):
                return self.insert_void(tag, token[2])
            if tag == "title":
                return self.raw(token, "rcdata")
            if tag in ("noframes", "style"):
                return self.raw(token, "rawtext")
            if tag == "noscript":
                self.insert(tag, token[2])
                self.mode = "in_head_noscript"
                return None
            if tag == "script":
                return self.raw(token, "script")
            if tag == "template":
                self.insert(tag, token[2])
                self.active.append(None)
                self.frames_ok = False
                self.mode = "in_template"
                self.templates.append("in_template")
                return None
            if tag == "head":
                return self.error("unexpected start tag")
        if kind == "end":
            tag = token[1]
            if tag == "head":
                self.open.pop()
                self.mode = "after_head"
                return None
            if tag == "template":
                return self.end_template()
            if tag not in ("body", "html", "br"):
                return self.error("unexpected end tag")
        self.open.pop()
        self.mode = "after_head"
        return token

    def end_template(self) -> None:
        if not self.is_open("template"):
            return self.error("unexpected end tag")
        self.implied(among=IMPLIED_ALL)
        self.pop_to("template")
        self.clear_active()
        self.templates.pop()
        self.reset()

    def in_head_noscript(self, token: tuple):
        kind = token[0]
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "start" and token[1] == "html":
            return self.in_body(token)
        if kind == "end" and token[1] == "noscript":
            self.open.pop()
            self.mode = "in_head"
            return None
        if kind == "text":
            white, token = self.lead(token)
            self.text(white)
            if token is None:
                return None
        if kind == "comment" or kind == "start" and token[1] in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
            return self.in_head(token)
        if kind == "start" and token[1] in ("head", "noscript") or kind == "end" and token[1] != "br":
            return self.error("unexpected tag in noscript")
        self.error("unexpected content in noscript")
        self.open.pop()
        self.mode = "in_head"
        return token

    def after_head(self, token: tuple):
        kind = token[0]
        if kind == "text":
            white, token = self.lead(token)
            self.text(white)
            if token is None:
                return None
        if kind == "comment":
            return self.comment(token[1])
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "start":
            tag = token[1]
            if tag == "html":
                return self.in_body(token)
            if tag == "body":
                self.insert("body", token[2])
                self.frames_ok, self.mode = False, "in_body"
                return None
            if tag == "frameset":
                self.insert("frameset", token[2])
                self.mode = "in_frameset"
                return None
            if tag in HEAD_ONLY:
                self.error("unexpected start tag after head")
                self.open.append(self.head)
                self.in_head(token)
                self.open.remove(self.head)
                return None
            if tag == "head":
                return self.error("unexpected start tag")
        if kind == "end":
            if token[1] == "template":
                return self.in_head(token)
            if token[1] not in ("body", "html", "br"):
                return self.error("unexpected end tag")
        self.insert("body")
        self.mode = "in_body"
        return token

    def in_body(self, token: tuple):
        kind = token[0]
        if kind == "text":
            data = token[1].replace("\0", "")
            if data:
                self.reconstruct()
                self.text(data)
                if data.strip(WHITE):
                    self.frames_ok = False
            return None
        if kind == "comment":
            return self.comment(token[1])
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "eof":
            return self.in_template(token) if self.templates else None
        return self.start_in_body(token) if kind == "start" else self.end_in_body(token[1])

    def start_in_body(self, token: tuple):
        _, tag, attrs, closed = token
        if tag == "html":
            self.error("unexpected start tag")
            if not self.is_open("template"):
                self.merge(self.open[0], attrs)
        elif tag in HEAD_ONLY:
            return self.in_head(token)
        elif tag == "body":
            self.error("unexpected start tag")
            if len(self.open) > 1 and self.open[1].tag == "body" and not self.is_open("template"):
                self.frames_ok = False
                self.merge(self.open[1], attrs)
        elif tag == "frameset":
            self.error("unexpected start tag")
            if len(self.open) > 1 and self.open[1].tag == "body" and self.frames_ok:
                self.open[1].detach()
                del self.open[1:]
                self.insert(tag, attrs)
                self.mode = "in_frameset"
        elif tag in BLOCKS:
            self.close_p_in_button()
            self.insert(tag, attrs)
        elif tag in HEADINGS:
            self.close_p_in_button()
            if self.open[-1].ns == HTML and self.open[-1].tag in HEADINGS:
                self.error("heading within a heading")
                self.open.pop()
            self.insert(tag, attrs)
        elif tag in ("pre", "listing"):
            self.close_p_in_button()
            self.insert(tag, attrs)
            self.skip_lf, self.frames_ok = True, False
        elif tag == "form":
            template = self.is_open("template")
            if self.form is not None and not template:
                return self.error("form within a form")
            self.close_p_in_button()
            node = self.insert(tag, attrs)
            if not template:
                self.form = node
        elif tag in ("li", "dd", "dt"):
            self.frames_ok = False
            names = {"li"} if tag == "li" else {"dd", "dt"}
            for node in reversed(self.open):
                if node.ns == HTML and node.tag in names:
                    self.implied(node.tag)
                    self.pop_to(node.tag)
                    break
                if self.special(node) and not (node.ns == HTML and node.tag in ("address", "div", "p")):
                    break
            self.close_p_in_button()
            self.insert(tag, attrs)
        elif tag == "plaintext":
            self.close_p_in_button()
            self.insert(tag, attrs)
            self.tokens.mode = "plaintext"
        elif tag == "button":
            if self.has("button"):
                self.error("button within a button")
                self.implied()
                self.pop_to("button")
            self.reconstruct()
            self.insert(tag, attrs)
            self.frames_ok = False
        elif tag in FORMATTING:
            if tag == "a":
                for other in reversed(self.active):
                    if other is None:
                        break
                    if other.tag == "a":
                        self.error("link within a link")
                        self.adopt("a")
                        if other in self.active:
                            self.active.remove(other)
                        if other in self.open:
                            self.open.remove(other)
                        break
            self.reconstruct()
            if tag == "nobr" and self.has("nobr"):
                self.error("nobr within nobr")
                self.adopt("nobr")
                self.reconstruct()
            self.push_active(self.insert(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(tag, attrs)
            self.active.append(None)
            self.frames_ok = False
        elif tag == "table":
            if self.doc.quirks != "quirks":
                self.close_p_in_button()
            self.insert(tag, attrs)
            self.frames_ok, self.mode = False, "in_table"
        elif tag in VOID_IN_BODY:
            self.reconstruct()
            self.insert_void(tag, attrs)
            self.frames_ok = False
        elif tag == "input":
            self.reconstruct()
            self.insert_void(tag, attrs)
            if dict(attrs).get("type", "").lower() != "hidden":
                self.frames_ok = False
        elif tag in ("param", "source", "track"):
            self.insert_void(tag, attrs)
        elif tag == "hr":
            self.close_p_in_button()
            self.insert_void(tag, attrs)
            self.frames_ok = False
        elif tag == "image":
            return ("start", "img", attrs, closed)
        elif tag == "textarea":
            self.raw(token, "rcdata")
            self.skip_lf, self.frames_ok = True, False
        elif tag == "xmp":
            self.close_p_in_button()
            self.reconstruct()
            self.frames_ok = False
            self.raw(token, "rawtext")
        elif tag == "iframe":
            self.frames_ok = False
            self.raw(token, "rawtext")
        elif tag == "noembed":
            self.raw(token, "rawtext")
        elif tag == "select":
            self.reconstruct()
            self.insert(tag, attrs)
            self.frames_ok = False
            rows = ("in_table", "in_caption", "in_body_rows", "in_row", "in_cell")
            self.mode = "in_select_in_table" if self.mode in rows else "in_select"
        elif tag in ("optgroup", "option"):
            if self.open[-1].tag == "option":
                self.open.pop()
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.has("ruby"):
                self.implied("rtc" if tag in ("rp", "rt") else None)
            self.insert(tag, attrs)
        elif tag in ("math", "svg"):
            self.reconstruct()
            self.start_foreign(tag, attrs, MATH if tag == "math" else SVG, closed)
        elif tag in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.error("unexpected start tag")
        else:
            self.reconstruct()
            self.insert(tag, attrs)
        return None

    def end_in_body(self, tag: str):
        if tag == "template":
            return self.end_template()
        if tag in ("body", "html"):
            if not self.has("body"):
                return self.error("unexpected end tag")
            self.mode = "after_body"
            return ("end", tag) if tag == "html" else None
        if tag in CLOSED_BLOCKS:
            if not self.has(tag):
                return self.error("unexpected end tag")
            self.implied()
            self.pop_to(tag)
        elif tag == "form":
            if self.is_open("template"):
                if not self.has("form"):
                    return self.error("unexpected end tag")
                self.implied()
                self.pop_to("form")
                return None
            node, self.form = self.form, None
            if node is None or node not in self.open or not self.has("form"):
                return self.error("unexpected end tag")
            self.implied()
            self.open.remove(node)
        elif tag == "p":
            if not self.has("p", BUTTON_SCOPE):
                self.error("unexpected end tag")
                self.insert("p")
            self.close_p()
        elif tag in ("li", "dd", "dt"):
            if not self.has(tag, LIST_SCOPE if tag == "li" else SCOPE):
                return self.error("unexpected end tag")
            self.implied(tag)
            self.pop_to(tag)
        elif tag in HEADINGS:
            if not self.has(HEADINGS):
                return self.error("unexpected end tag")
            self.implied()
            self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            if not self.adopt(tag):
                self.any_end(tag)
        elif tag in ("applet", "marquee", "object"):
            if not self.has(tag):
                return self.error("unexpected end tag")
            self.implied()
            self.pop_to(tag)
            self.clear_active()
        elif tag == "br":
            self.error("unexpected end tag")
            return ("start", "br", [], False)
        else:
            self.any_end(tag)
        return None

    def any_end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node = self.open[i]
            if node.ns == HTML and node.tag == tag:
                self.implied(tag)
                del self.open[i:]
                return
            if self.special(node):
                self.error("unexpected end tag")
                return

    def in_text(self, token: tuple):
        if token[0] == "text":
            return self.text(token[1])
        self.open.pop()
        self.mode = self.back
        return token if token[0] == "eof" else None

    def in_table(self, token: tuple):
        kind = token[0]
        if kind == "text" and self.open[-1].tag in ("table", "tbody", "template", "tfoot", "thead", "tr"):
            self.table_text, self.back, self.mode = [], self.mode, "in_table_text"
            return token
        if kind == "comment":
            return self.comment(token[1])
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "eof":
            return self.in_body(token)
        if kind == "start":
            tag, attrs = token[1], token[2]
            if tag == "caption":
                self.clear_to({"table"})
                self.active.append(None)
                self.insert(tag, attrs)
                self.mode = "in_caption"
                return None
            if tag in ("colgroup", "col"):
                self.clear_to({"table"})
                self.insert("colgroup", attrs if tag == "colgroup" else ())
                self.mode = "in_columns"
                return token if tag == "col" else None
            if tag in ("tbody", "tfoot", "thead", "td", "th", "tr"):
                self.clear_to({"table"})
                own = tag in ("tbody", "tfoot", "thead")
                self.insert(tag if own else "tbody", attrs if own else ())
                self.mode = "in_body_rows"
                return None if own else token
            if tag == "table":
                self.error("table within a table")
                if not self.has("table", TABLE_SCOPE):
                    return None
                self.pop_to("table")
                self.reset()
                return token
            if tag in ("style", "script", "template"):
                return self.in_head(token)
            if tag == "input" and dict(attrs).get("type", "").lower() == "hidden":
                return self.insert_void(tag, attrs)
            if tag == "form":
                if self.form is None and not self.is_open("template"):
                    self.form = self.insert(tag, attrs)
                    self.open.pop()
                return None
        if kind == "end":
            tag = token[1]
            if tag == "table":
                if not self.has("table", TABLE_SCOPE):
                    return self.error("unexpected end tag")
                self.pop_to("table")
                self.reset()
                return None
            if tag in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return self.error("unexpected end tag")
            if tag == "template":
                return self.in_head(token)
        return self.fostered(token)

    def fostered(self, token: tuple):
        self.error("unexpected content in a table")
        self.foster = True
        again = self.in_body(token)
        while again is not None and again[0] == "start" and again[1] in ("img", "br"):
            again = self.in_body(again)
        self.foster = False
        return again

    def in_table_text(self, token: tuple):
        if token[0] == "text":
            self.table_text.append(token[1].replace("\0", ""))
            return None
        data = "".join(self.table_text)
        self.mode = self.back
        if data.strip(WHITE):
            self.fostered(("text", data))
        else:
            self.text(data)
        return token

    def in_caption(self, token: tuple):
        kind = token[0]
        table = kind == "start" and token[1] in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr") or kind == "end" and token[1] == "table"
        if table or kind == "end" and token[1] == "caption":
            if not self.has("caption", TABLE_SCOPE):
                return self.error("unexpected tag")
            self.implied()
            self.pop_to("caption")
            self.clear_active()
            self.mode = "in_table"
            return token if table else None
        if kind == "end" and token[1] in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return self.error("unexpected end tag")
        return self.in_body(token)

    def in_columns(self, token: tuple):
        kind = token[0]
        if kind == "text":
            white, token = self.lead(token)
            self.text(white)
            if token is None:
                return None
        if kind == "comment":
            return self.comment(token[1])
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "eof" or kind == "start" and token[1] == "html":
            return self.in_body(token)
        if kind == "start" and token[1] == "col":
            return self.insert_void("col", token[2])
        if kind in ("start", "end") and token[1] == "template":
            return self.in_head(token)
        if kind == "end" and token[1] == "col":
            return self.error("unexpected end tag")
        if self.open[-1].tag != "colgroup":
            return self.error("unexpected content in column group")
        self.open.pop()
        self.mode = "in_table"
        return None if kind == "end" and token[1] == "colgroup" else token

    def in_body_rows(self, token: tuple):
        kind = token[0]
        if kind == "start" and token[1] in ("tr", "td", "th"):
            self.clear_to({"tbody", "tfoot", "thead"})
            self.insert("tr", token[2] if token[1] == "tr" else ())
            self.mode = "in_row"
            return None if token[1] == "tr" else token
        if kind == "end" and token[1] in ("tbody", "tfoot", "thead"):
            if not self.has(token[1], TABLE_SCOPE):
                return self.error("unexpected end tag")
            self.clear_to({"tbody", "tfoot", "thead"})
            self.open.pop()
            self.mode = "in_table"
            return None
        if kind == "start" and token[1] in ("caption", "col", "colgroup", "tbody", "tfoot", "thead") or kind == "end" and token[1] == "table":
            if not self.has({"tbody", "tfoot", "thead"}, TABLE_SCOPE):
                return self.error("unexpected tag")
            self.clear_to({"tbody", "tfoot", "thead"})
            self.open.pop()
            self.mode = "in_table"
            return token
        if kind == "end" and token[1] in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return self.error("unexpected end tag")
        return self.in_table(token)

    def in_row(self, token: tuple):
        kind = token[0]
        if kind == "start" and token[1] in ("td", "th"):
            self.clear_to({"tr"})
            self.insert(token[1], token[2])
            self.mode = "in_cell"
            self.active.append(None)
            return None
        rows = ("tbody", "tfoot", "thead")
        if kind == "end" and token[1] in ("tr", "table", *rows) or kind == "start" and token[1] in ("caption", "col", "colgroup", "tr", *rows):
            if kind == "end" and token[1] in rows and not self.has(token[1], TABLE_SCOPE) or not self.has("tr", TABLE_SCOPE):
                return self.error("unexpected tag")
            self.clear_to({"tr"})
            self.open.pop()
            self.mode = "in_body_rows"
            return None if kind == "end" and token[1] == "tr" else token
        if kind == "end" and token[1] in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return self.error("unexpected end tag")
        return self.in_table(token)

    def in_cell(self, token: tuple):
        kind = token[0]
        if kind == "end" and token[1] in ("td", "th"):
            if not self.has(token[1], TABLE_SCOPE):
                return self.error("unexpected end tag")
            self.implied()
            self.pop_to(token[1])
            self.clear_active()
            self.mode = "in_row"
            return None
        start = kind == "start" and token[1] in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if start or kind == "end" and token[1] in ("table", "tbody", "tfoot", "thead", "tr"):
            if not self.has({"td", "th"} if start else token[1], TABLE_SCOPE):
                return self.error("unexpected tag")
            self.implied()
            self.pop_to({"td", "th"})
            self.clear_active()
            self.mode = "in_row"
            return token
        if kind == "end" and token[1] in ("body", "caption", "col", "colgroup", "html"):
            return self.error("unexpected end tag")
        return self.in_body(token)

    def in_select(self, token: tuple):
        kind = token[0]
        if kind == "text":
            return self.text(token[1].replace("\0", ""))
        if kind == "comment":
            return self.comment(token[1])
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "eof":
            return self.in_body(token)
        tag = token[1]
        if kind == "start":
            if tag == "html":
                return self.in_body(token)
            if tag in ("option", "optgroup", "hr"):
                if self.open[-1].tag == "option":
                    self.open.pop()
                if tag != "option" and self.open[-1].tag == "optgroup":
                    self.open.pop()
                self.insert(tag, token[2])
                if tag == "hr":
                    self.open.pop()
                return None
            if tag in ("select", "input", "keygen", "textarea"):
                self.error("unexpected start tag in select")
                if not self.in_select_scope():
                    return None
                self.pop_to("select")
                self.reset()
                return None if tag == "select" else token
            if tag in ("script", "template"):
                return self.in_head(token)
            return self.error("unexpected start tag in select")
        if tag == "optgroup":
            if self.open[-1].tag == "option" and self.open[-2].tag == "optgroup":
                self.open.pop()
            if self.open[-1].tag == "optgroup":
                self.open.pop()
        elif tag == "option":
            if self.open[-1].tag == "option":
                self.open.pop()
        elif tag == "select":
            if self.in_select_scope():
                self.pop_to("select")
                self.reset()
        elif tag == "template":
            return self.in_head(token)
        else:
            self.error("unexpected end tag in select")
        return None

    def in_select_scope(self) -> bool:
        for node in reversed(self.open):
            if node.tag == "select":
                return True
            if node.tag not in ("optgroup", "option"):
                return False
        return False

    def in_select_in_table(self, token: tuple):
        if token[0] in ("start", "end") and token[1] in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            self.error("unexpected tag in select")
            if token[0] == "end" and not self.has(token[1], TABLE_SCOPE):
                return None
            self.pop_to("select")
            self.reset()
            return token
        return self.in_select(token)

    def in_template(self, token: tuple):
        kind = token[0]
        if kind in ("text", "comment", "doctype"):
            return self.in_body(token)
        if kind == "eof":
            if not self.is_open("template"):
                return None
            self.error("end of file in template")
            self.pop_to("template")
            self.clear_active()
            self.templates.pop()
            self.reset()
            return token
        tag = token[1]
        if tag in HEAD_ONLY and kind == "start" or kind == "end" and tag == "template":
            return self.in_head(token)
        if kind == "end":
            return self.error("unexpected end tag")
        modes = {"col": "in_columns", "tr": "in_body_rows", "td": "in_row", "th": "in_row"} | dict.fromkeys(("caption", "colgroup", "tbody", "tfoot", "thead"), "in_table")
        self.mode = self.templates[-1] = modes.get(tag, "in_body")
        return token

    def after_body(self, token: tuple):
        kind = token[0]
        if kind == "text" and not token[1].strip(WHITE):
            return self.in_body(token)
        if kind == "comment":
            return self.comment(token[1], self.open[0])
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "start" and token[1] == "html":
            return self.in_body(token)
        if kind == "end" and token[1] == "html":
            if self.context is None:
                self.mode = "after_after_body"
            return None
        if kind == "eof":
            return None
        self.error("content after body")
        self.mode = "in_body"
        return token

    def in_frameset(self, token: tuple):
        kind = token[0]
        if kind == "text":
            return self.text("".join(c for c in token[1] if c in WHITE))
        if kind == "comment":
            return self.comment(token[1])
        if kind == "start":
            if token[1] == "html":
                return self.in_body(token)
            if token[1] == "frameset":
                self.insert(token[1], token[2])
                return None
            if token[1] == "frame":
                return self.insert_void(token[1], token[2])
            if token[1] == "noframes":
                return self.in_head(token)
        if kind == "end" and token[1] == "frameset":
            if len(self.open) > 1:
                self.open.pop()
                if self.context is None and self.open[-1].tag != "frameset":
                    self.mode = "after_frameset"
            return None
        return None if kind == "eof" else self.error("unexpected content in frameset")

    def after_frameset(self, token: tuple):
        kind = token[0]
        if kind == "text":
            return self.text("".join(c for c in token[1] if c in WHITE))
        if kind == "comment":
            return self.comment(token[1])
        if kind == "start" and token[1] == "html":
            return self.in_body(token)
        if kind == "start" and token[1] == "noframes":
            return self.in_head(token)
        if kind == "end" and token[1] == "html":
            self.mode = "after_after_frameset"
            return None
        return None if kind == "eof" else self.error("unexpected content after frameset")

    def after_after_body(self, token: tuple):
        kind = token[0]
        if kind == "comment":
            return self.comment(token[1], self.doc.root)
        if kind == "doctype" or kind == "text" and not token[1].strip(WHITE) or kind == "start" and token[1] == "html":
            return self.in_body(token)
        if kind == "eof":
            return None
        self.error("content after the end of the document")
        self.mode = "in_body"
        return token

    def after_after_frameset(self, token: tuple):
        kind = token[0]
        if kind == "comment":
            return self.comment(token[1], self.doc.root)
        if kind == "start" and token[1] == "noframes":
            return self.in_head(token)
        if kind == "doctype" or kind == "text" and not token[1].strip(WHITE) or kind == "start" and token[1] == "html":
            return self.in_body(token)
        return None if kind == "eof" else self.error("unexpected content after frameset")

    # -- foreign content --

    def start_foreign(self, tag: str, attrs, ns: str, closed: bool) -> None:
        if ns == MATH:
            attrs = [("definitionURL" if k == "definitionurl" else k, v) for k, v in attrs]
        else:
            attrs = [(SVG_ATTRS.get(k, k), v) for k, v in attrs]
        self.insert(tag, attrs, ns)
        if closed:
            self.open.pop()

    def foreign(self, token: tuple):
        kind = token[0]
        if kind == "text":
            if token[1].strip(WHITE + "\0"):
                self.frames_ok = False
            return self.text(token[1].replace("\0", "�"))
        if kind == "comment":
            return self.comment(token[1])
        if kind == "doctype":
            return self.error("unexpected doctype")
        if kind == "start":
            tag, attrs = token[1], token[2]
            if tag in BREAKOUT or tag == "font" and {"color", "face", "size"} & {k for k, _ in attrs}:
                self.error("html element in foreign content")
                while self.open[-1].ns != HTML and not self.html_point(self.open[-1]) and not (self.open[-1].ns == MATH and self.open[-1].tag in MATH_TEXT):
                    self.open.pop()
                return getattr(self, self.mode)(token)
            ns = self.open[-1].ns
            return self.start_foreign(SVG_TAGS.get(tag, tag) if ns == SVG else tag, attrs, ns, token[3])
        tag = token[1]
        if tag in ("br", "p"):
            self.error("html element in foreign content")
            while self.open[-1].ns != HTML and not self.html_point(self.open[-1]) and not (self.open[-1].ns == MATH and self.open[-1].tag in MATH_TEXT):
                self.open.pop()
            return getattr(self, self.mode)(token)
        for i in range(len(self.open) - 1, 0, -1):
            node = self.open[i]
            if node.ns == HTML:
                return getattr(self, self.mode)(token)
            if node.tag.lower() == tag:
                del self.open[i:]
                return None
        return None


def parse_document(html: str | None) -> Document:
    """A whole document; null counts as empty."""
    return Builder(html or "", False).run()


def parse_fragment(html: str | None) -> Document:
    """A fragment as the content of a body: its nodes stand under the html element of the root."""
    return Builder(html or "", True).run()
