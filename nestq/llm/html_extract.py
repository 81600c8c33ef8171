"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded hierarchically.

A page is parsed to block-level nodes.  Each node has features of its subtree (text, density, links,
punctuation), its tag and attribute tokens, its depth and place, and its siblings and parent.  Boosted
trees give the probability that a node is to be kept.  Decoding chooses, for the whole tree at once,
between *drop* (and with it everything below) and *keep* (children decide for themselves) so that the
sum of the log probabilities is largest; no descendant can contradict a dropped ancestor.

The trees are trained on generated pages of many layouts and on a bounded, hashed sample of the table
(``SAMPLE_PAGES``), weakly labelled where tags or attributes say what a node is.  Every labelled node is
also shown without its tag and attribute evidence, so that layout alone can decide elsewhere.

Attribute tokens (words of class, id, role and itemprop) count twice: against what HTML's own vocabulary
says, and hashed, by what the labelled pages say of them.

The sample takes pages up to ``longest`` characters, of the table's whole; all pages are extracted.  Elements
nested deeper than ``MOST_DEPTH`` are read as neighbours at that depth.  A tag is read up to ``LONGEST_TAG``
characters with quotes minded; where it has no end by then, as after a quote that is never closed, quotes
mean nothing for as long and tags end at the next ``>``.  So reading takes time linear in the page.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one
space in page order.  Null and empty pages, and pages without main text, give the empty string.  Broken
markup is read as far as it goes.  At equal sums a node is kept.  Ill-formed UTF-8 is read as U+FFFD.  Rows are
independent; repeated rows get equal results, keys of any type and other columns pass through, but for
main_text, which is replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.llm.common import arrow_map, as_texts, restored, sliced, table

#: What HTML says about its elements.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button select option label iframe".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head script style template noscript title svg math object".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "svg", "template"}
CLOSES_P = BLOCKS - {"body", "html", "button", "label", "option", "select", "iframe", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
HOLDS = {"ul", "ol", "dl", "menu", "table", "tbody", "thead", "tfoot", "body", "div", "section", "article", "main", "nav", "select"}
KEEP_TAGS, TEXT_TAGS, HEADINGS = {"article", "main"}, {"p", "blockquote", "pre", "dd", "figcaption"}, {"h1", "h2", "h3", "h4", "h5", "h6"}
DROP_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "select", "option", "label", "fieldset", "iframe", "dialog"}
KEEP_TOKENS = set("article articlebody body content entry main post story text prose".split())
DROP_TOKENS = set("ad ads advert advertisement adverts advertorial alert banner breadcrumb breadcrumbs byline comment comments commentlist complementary contentinfo cookie cookies consent copyright disqus dropdown footer form header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related reply replies rail respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar widget disclaimer gdpr".split())
#: What may be a tag begins so; the rest of a tag is read without going back, up to LONGEST_TAG characters.
OPENER = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
LONGEST_TAG = 1 << 16
MOST_DEPTH = 512
NAMED = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SAMPLE_PAGES = 300
TREES, DEPTH, BINS, SHRINK = 60, 3, 32, 0.2
FEATURES = 34
#: Features that hold tag and attribute evidence; the last four are what training pages say of hashed tokens.
SEMANTIC = slice(20, 34)
LEARNT = 30
#: Buckets of hashed attribute tokens.
BUCKETS = 1 << 12


class Page:
    """Block-level nodes of a page in order, and the runs of text in them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens = ["html"], [-1], [0], [frozenset()]
        self.inline, self.blocks = [0], []  # inline tags per node; blocks: [node, text, characters in links]
        self._read(source)

    def _read(self, source: str) -> None:
        open_: list[tuple[str, int]] = [("html", 0)]  # block elements, innermost last
        unseen, links, run, linked = 0, 0, [], 0

        def flush() -> None:
            nonlocal run, linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    self.blocks.append((open_[-1][1], text, linked))
                run, linked = [], 0

        def close_to(k: int) -> None:
            flush()
            del open_[k:]

        at, end = 0, len(source)
        last = source.rfind(">")  # no tag ends after it
        broken = 0  # quotes mean nothing before this place: one was never closed
        while at < end:
            m = OPENER.search(source, at, last + 1) if at <= last else None
            upto = m.start() if m else end
            if not m and (comment := source.find("<!--", at)) >= 0:
                upto = comment  # one that is never closed
            if upto > at and not unseen:
                piece = source[at:upto]
                run.append(piece)
                if links:
                    linked += len(piece)
            if not m:
                break
            if not m[2]:
                mark = "-->" if m[0] == "<!--" else ">"
                stop = source.find(mark, m.end())
                at = stop + len(mark) if stop >= 0 else end
                continue
            rest = REST.match(source, m.end(), min(end, m.end() + LONGEST_TAG)) if m.end() >= broken else None
            if rest is None and m.end() >= broken:
                broken = m.end() + LONGEST_TAG
            stop = rest.end() if rest else source.find(">", m.end()) + 1
            attributes = source[m.end() : stop - 1]
            at = stop
            closing, name = bool(m[1]), m[2].lower()
            if name in UNSEEN or name in RAW:
                if not closing and not attributes.endswith("/") and name != "head":
                    stop = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(source, at)
                    at = stop.end() if stop else end
                elif name == "head":
                    unseen = 0 if closing else 1
                continue
            if name == "body":
                unseen = 0
            if name in ("br", "hr"):
                flush()
            elif name == "a":
                links = 0 if closing else 1
                self.inline[open_[-1][1]] += not closing
            elif name not in BLOCKS:
                if not closing and name not in VOID:
                    self.inline[open_[-1][1]] += 1
            elif closing:
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] == name:
                        close_to(k)
                        break
                else:
                    flush()
                links = 0
            elif name not in ("html",):
                flush()
                links = 0
                if name in CLOSES_P or name in SAME:
                    ends = SAME.get(name, set()) | ({"p"} if name in CLOSES_P else set())
                    for k in range(len(open_) - 1, 0, -1):
                        if open_[k][0] in ends:
                            close_to(k)
                            break
                        if open_[k][0] in HOLDS or open_[k][0] in BLOCKS - {"p", *HEADINGS} - set(SAME):
                            break
                parent = open_[-1][1]
                self.tag.append(name)
                self.parent.append(parent)
                self.depth.append(self.depth[parent] + 1)
                self.tokens.append(self._tokens(attributes))
                self.inline.append(0)
                if len(open_) < MOST_DEPTH:  # deeper ones stay flat
                    open_.append((name, len(self.tag) - 1))
        flush()

    @staticmethod
    def _tokens(attributes: str) -> frozenset:
        if not attributes or attributes.isspace():
            return frozenset()
        found: set[str] = set()
        for m in NAMED.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "style":
                if "display:none" in value.replace(" ", "").lower():
                    found.add("#hidden")
            elif name in ("hidden", "aria-hidden"):
                if value.lower() != "false":
                    found.add("#hidden")
            else:
                found.update(p.lower() for p in PART.findall(value))
        return frozenset(found)

    def buckets(self, k: int) -> list[int]:
        """Hashes of a node's attribute tokens, each together with its tag and alone."""
        return [crc32(t.encode()) % BUCKETS for token in self.tokens[k] for t in (token, f"{self.tag[k]} {token}")]

    def features(self, odds: list[float] | None = None) -> np.ndarray:
        """(nodes, FEATURES); 20 on are tag and attribute evidence.  odds: by bucket, log odds to be kept."""
        n = len(self.tag)
        chars, links, words, marks, runs, tags = ([0.0] * n for _ in range(6))
        offset, total = [-1.0] * n, 0.0
        for node, text, linked in self.blocks:
            chars[node] += len(text)
            links[node] += min(linked, len(text))
            words[node] += text.count(" ") + 1
            marks[node] += sum(map(text.count, ".,;:!?"))
            runs[node] += 1
            if offset[node] < 0:
                offset[node] = total
            total += len(text)
        direct = list(chars)
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            children[p].append(k)
            for a in (chars, links, words, marks, runs):
                a[p] += a[k]
            tags[k] += 1 + self.inline[k]
            tags[p] += tags[k]
            if offset[k] >= 0 and (offset[p] < 0 or offset[k] < offset[p]):
                offset[p] = offset[k]
        out = np.zeros((n, FEATURES))
        keep_above, drop_above = [0] * n, [0] * n
        log = np.log1p
        for k in range(n):
            p = self.parent[k]
            tag, tokens = self.tag[k], self.tokens[k]
            good, bad = (tag in KEEP_TAGS) + len(tokens & KEEP_TOKENS), (tag in DROP_TAGS) + len(tokens & DROP_TOKENS)
            if tag == "header" and not (p >= 0 and keep_above[p]):
                bad += 1
            if p >= 0:
                keep_above[k], drop_above[k] = keep_above[p], drop_above[p]
            row = out[k]
            row[20:30] = (good, bad, keep_above[k], drop_above[k], tag in KEEP_TAGS, tag in DROP_TAGS, tag in TEXT_TAGS, tag in HEADINGS, tag in ("li", "ul", "ol", "td", "th", "table", "tr"), "#hidden" in tokens)
            if odds is not None:
                said = [odds[x] for x in self.buckets(k)]
                low, high = (min(said), max(said)) if said else (0.0, 0.0)
                above = out[p, LEARNT + 2 : LEARNT + 4] if p >= 0 else (0.0, 0.0)
                row[LEARNT : LEARNT + 4] = (low, high, min(low, above[0]), max(high, above[1]))
            keep_above[k] += good > 0
            drop_above[k] += bad > 0
            row[:9] = (chars[k], links[k] / max(chars[k], 1), chars[k] / (tags[k] + 1), self.depth[k], max(offset[k], 0) / max(total, 1), chars[k] / max(total, 1), words[k] / max(runs[k], 1), marks[k] / max(words[k], 1), direct[k] / max(chars[k], 1))
            row[15], row[16] = tags[k], runs[k]
            paragraphs = sum(self.tag[c] == "p" for c in children[k])
            row[17] = paragraphs
            if p >= 0:
                row[9:11] = (chars[k] / max(chars[p], 1), links[p] / max(chars[p], 1))
        for siblings in children:
            siblings.reverse()
            m = len(siblings)
            for i, k in enumerate(siblings):
                row = out[k]
                row[11:15] = (m, i / m, chars[siblings[i - 1]] if i else 0, chars[siblings[i + 1]] if i + 1 < m else 0)
                row[18] = sum(self.tag[s] == self.tag[k] for s in siblings[max(0, i - 4) : i + 5])
                row[19] = max((chars[s] for s in siblings[max(0, i - 4) : i + 5]), default=0)
        for c in (0, 2, 11, 13, 14, 15, 16, 17, 19):
            out[:, c] = log(out[:, c])
        return out

    def decode(self, keep: np.ndarray) -> str:
        """The text of the best consistent choice; keep: probability for each node."""
        n = len(self.tag)
        p = np.clip(keep, 1e-6, 1 - 1e-6)
        direct = [0.0] * n
        for node, text, _ in self.blocks:
            direct[node] += len(text)
        weight = 1 + np.log1p(np.array(direct))
        kept, dropped = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
        for k in range(n - 1, 0, -1):
            kept[self.parent[k]] += max(kept[k], dropped[k])
            dropped[self.parent[k]] += dropped[k]
        stay = [True] * n
        for k in range(1, n):
            stay[k] = stay[self.parent[k]] and (self.tag[k] == "body" or kept[k] >= dropped[k])
        return " ".join(text for node, text, _ in self.blocks if stay[node])

    def weak_labels(self) -> np.ndarray:
        """1 keep, 0 drop, -1 unknown: from tags and attributes; a container is dropped if nearly all its text is."""
        n = len(self.tag)
        state = [-1] * n
        for k in range(1, n):
            p, tag, tokens = self.parent[k], self.tag[k], self.tokens[k]
            good, bad = tag in KEEP_TAGS or bool(tokens & KEEP_TOKENS), tag in DROP_TAGS or bool(tokens & DROP_TOKENS) or "#hidden" in tokens or (tag == "header" and state[p] != 1)
            state[k] = state[p]
            if bad and not (good and tag in KEEP_TAGS):
                state[k] = 0
            elif good and state[p] != 0:
                state[k] = 1
        sums = [[0.0, 0.0, 0.0] for _ in range(n)]
        for node, text, _ in self.blocks:
            sums[node][state[node]] += len(text)
        for k in range(n - 1, 0, -1):
            for c in range(3):
                sums[self.parent[k]][c] += sums[k][c]
        return np.array([(-1 if u > 0.1 * (d + g + u) or d + g + u == 0 else int(g > 0.1 * (d + g))) for d, g, u in sums])


def learnt_odds(pages: list[Page], labels: list[np.ndarray]) -> list[float]:
    """For each bucket of hashed attribute tokens, the log odds that a labelled node which has one is kept."""
    kept, dropped = np.ones(BUCKETS), np.ones(BUCKETS)
    for page, label in zip(pages, labels, strict=True):
        for k in np.flatnonzero(label >= 0).tolist():
            for x in page.buckets(k):
                (kept if label[k] else dropped)[x] += 1
    return np.log(kept / dropped).tolist()


class Trees:
    """Gradient-boosted regression trees with logistic loss, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = self._bins(x)
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score, self.trees = np.full(len(y), self.prior), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._apply(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)

    @staticmethod
    def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete tree: feature and bin of each inner node, value of each leaf."""
        feature, at = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
        node = np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            width = 2**level
            best = np.full(width, 1e-9)
            for f in range(bins.shape[1]):
                key = node * (BINS + 1) + bins[:, f]
                a = np.cumsum(np.bincount(key, g, width * (BINS + 1)).reshape(width, -1), axis=1)
                b = np.cumsum(np.bincount(key, h, width * (BINS + 1)).reshape(width, -1), axis=1)
                ga, hb = a[:, -1:], b[:, -1:]
                gain = a**2 / (b + 1) + (ga - a) ** 2 / (hb - b + 1) - ga**2 / (hb + 1)
                gain[(b < 1) | (hb - b < 1)] = 0
                where = gain.argmax(axis=1)
                value = gain[np.arange(width), where]
                better = value > best
                inner = width - 1 + np.flatnonzero(better)
                feature[inner], at[inner], best[better] = f, where[better], value[better]
            mine = width - 1 + node
            node = node * 2 + (bins[np.arange(len(g)), feature[mine]] > at[mine])
        leaves = 2**DEPTH
        return feature, at, SHRINK * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)

    @staticmethod
    def _apply(tree: tuple, bins: np.ndarray) -> np.ndarray:
        feature, at, values = tree
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for level in range(DEPTH):
            mine = 2**level - 1 + node
            node = node * 2 + (bins[rows, feature[mine]] > at[mine])
        return values[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        return 1 / (1 + np.exp(-(self.prior + sum(self._apply(t, bins) for t in self.trees))))


def generated_page(rnd: random.Random) -> str:
    """A page of a random layout, with classes that say what its parts are (used for labels only)."""

    def words(n: int) -> str:
        return " ".join("".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randrange(1, 9))) for _ in range(n))

    def sentence() -> str:
        s = words(rnd.randrange(4, 22))
        return s.capitalize() + rnd.choice(".....!?")

    def paragraph(n: int) -> str:
        inner = " ".join(sentence() for _ in range(n))
        return inner if rnd.random() < 0.7 else inner + f' <a href="#">{words(2)}</a> ' + sentence()

    def listing(name: str) -> str:
        kind = rnd.choice(["nav", "div", "div", "aside"])
        items = "".join(f'<li><a href="/{i}">{words(rnd.randrange(1, 4))}</a></li>' for i in range(rnd.randrange(3, 14)))
        return f'<{kind} class="{name}"><ul>{items}</ul></{kind}>'

    def short(name: str) -> str:
        kind = rnd.choice(["div", "div", "section", "p", "aside"])
        return f'<{kind} class="{name}">{" ".join(sentence() for _ in range(rnd.randrange(1, 4)))}</{kind}>'

    def comments() -> str:
        each = "".join(f'<div class="comment"><p>{words(2)}</p><p>{paragraph(rnd.randrange(1, 4))}</p></div>' for _ in range(rnd.randrange(1, 6)))
        return f'<div class="comments"><h3>{words(2)}</h3>{each}</div>'

    def form() -> str:
        return f'<form class="search"><label>{words(2)}</label><input><button>{words(1)}</button></form>'

    body = f"<h1>{words(rnd.randrange(3, 10))}</h1>" if rnd.random() < 0.8 else ""
    for _ in range(rnd.randrange(1, 12)):
        r = rnd.random()
        if r < 0.75:
            body += f"<p>{paragraph(rnd.randrange(1, 7))}</p>"
        elif r < 0.83:
            body += f"<h2>{words(3)}</h2>"
        elif r < 0.9:
            body += "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rnd.randrange(2, 6))) + "</ul>"
        elif r < 0.95:
            body += f"<blockquote>{paragraph(2)}</blockquote>"
        else:
            body += short(rnd.choice(["ad", "related", "share", "notice"]))
    kind = rnd.choice(["article", "main", "div", "div"])
    main = f'<{kind} class="content">{body}</{kind}>'
    before = [f() for f in (lambda: listing("menu"), lambda: f'<div class="header">{words(3)}</div>', lambda: short("ad"), lambda: short("notice"), form) if rnd.random() < 0.5]
    after = [f() for f in (lambda: listing("sidebar"), comments, lambda: short("footer"), lambda: short("ad"), lambda: listing("related"), form) if rnd.random() < 0.5]
    rnd.shuffle(before)
    inside = "".join(before) + main + "".join(after)
    return f"<html><body>{'<div>' + inside + '</div>' if rnd.random() < 0.4 else inside}</body></html>"


def fit(pages: list[str], seed: int = 7, generated: int = 300) -> Trees:
    """Trees trained on generated pages and on the weak labels of ``pages``."""
    rnd = random.Random(seed)
    read = [Page(source) for source in [*(generated_page(rnd) for _ in range(generated)), *pages]]
    labels = [page.weak_labels() for page in read]
    odds = learnt_odds(read, labels)
    x = np.concatenate([page.features(odds)[y >= 0] for page, y in zip(read, labels, strict=True)])
    y = np.concatenate([y[y >= 0] for y in labels]).astype(float)
    plain = x.copy()
    plain[:, SEMANTIC] = 0
    trees = Trees(np.concatenate([x, plain]), np.concatenate([y, y]))
    trees.odds = odds
    return trees


def fit_table(pages: DataFrame, column: str = "html", key: str = "page_id", sample: int = SAMPLE_PAGES, longest: int = 200_000) -> Trees:
    """``fit`` on at most ``sample`` pages of the table, chosen by a hash of their key and text."""
    rows = pages.where(F.col(column).isNotNull() & (F.length(column) <= longest)).select(F.col(column).alias("h"), F.xxhash64(F.col(key).cast("string"), F.col(column)).alias("k"))
    # a share of the hashes that holds about twice the sample, whatever the table's size; the lowest ones are used
    n, span = rows.count(), 1 << 40
    chosen = rows.where(F.pmod("k", F.lit(span)) < int(span * min(1.0, 2 * sample / max(n, 1)))).collect()
    return fit([h for _, h in sorted((r["k"], r["h"]) for r in chosen)[:sample]])


def extract(pages: DataFrame, trees: Trees, column: str = "html") -> DataFrame:
    """``pages`` with main_text."""
    kept = pages.drop("main_text").withColumn("_html", F.col(f"`{column}`").cast("string"))
    sent = pages.sparkSession.sparkContext.broadcast(vars(trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = restored(Trees, sent.value)
        for b in sliced(batches, rows=64):
            texts: list[str] = []
            read = [Page(s or "") for s in as_texts(b.column(b.num_columns - 1))]
            features = [p.features(model.odds) for p in read]
            keep = model.predict(np.concatenate(features))
            at = 0
            for page, f in zip(read, features, strict=True):
                texts.append(page.decode(keep[at : at + len(f)]))
                at += len(f)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "main_text"])

    return arrow_map(kept, run, kept.drop("_html").schema.add("main_text", T.StringType()))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the main text and its length in code points."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, fit_table(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))
