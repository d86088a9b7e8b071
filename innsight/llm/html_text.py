"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks (``html_blocks``). Each block has features of its
ancestors (tags, words of their class, id and role, of all and of the innermost section) and of its text (length,
share of links, how it ends). The field scores a labelling of all blocks of a
page, main or not, by its features and by the labels of neighbours; it is
trained on labelled pages by maximum likelihood with the forward-backward
recursion, and a page is decoded by Viterbi, in time linear in its blocks.

Training is on made pages of fixed number (``html_training``), on the driver;
pages are extracted by Spark, whole, one by one.

Defined cases: a null page counts as empty and has an empty text; a page without
main blocks has an empty text; a page cut off anywhere is read as far as it
goes; rows repeated whole give equal results; an empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.html_blocks import Block, leaf_blocks
from innsight.llm.html_training import labelled_pages
from innsight.llm.tables import column, read_table

TRAINING_PAGES = 1_000
STEPS, RATE, PENALTY = 200, 0.1, 2e-4

# Words of class names, ids and roles that tell parts of a page, by part.
PART_WORDS = {
    "advert": "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored",
    "notice": "alert alertdialog consent cookie cookies dialog disclaimer gdpr legal message modal newsletter notice notification paywall popup privacy subscribe subscription toast warning",
    "menu": "breadcrumb breadcrumbs menu menubar nav navbar navigation pager pagination tabs toc toolbar",
    "header": "header masthead topbar",
    "footer": "bottom colophon contentinfo copyright footer",
    "sidebar": "aside complementary more popular recommended related rail sidebar trending widget widgets",
    "social": "follow share sharing social",
    "comments": "comment commenter commentlist comments discussion disqus replies reply respond responses",
    "form": "button contact form input login newsletter search signup",
    "article": "article articlebody body content entry main post story text",
    "hidden": "hidden",
}
_PART_OF: dict[str, list[str]] = {}
for _part, _words in PART_WORDS.items():
    for _word in _words.split():
        _PART_OF.setdefault("#" + _word, []).append("part:" + _part)


AGAINST = frozenset(
    [f"part:{p}" for p in PART_WORDS if p not in ("article", "header")]
    + [f"in:{t}" for t in ("aside", "button", "dialog", "footer", "form", "nav")]
)


def block_features(block: Block, place: int, count: int) -> list[str]:
    """Names of the features a block has."""
    text, size = block.text, len(block.text)
    words = text.count(" ") + 1
    out = ["always", "leaf:" + block.leaf]
    for mark in block.marks:
        if mark[0] == "#":
            out += _PART_OF.get(mark, ())
        else:
            out.append("in:" + mark)
    for mark in block.inner:
        out += ["inner " + part for part in _PART_OF.get(mark, ())] if mark[0] == "#" else ["inner:" + mark]
    # inside an article with nothing that speaks against it
    if not any(f in AGAINST for f in out):
        out.append("clean")
        if "in:article" in out or "in:main" in out or "part:article" in out:
            out.append("clean article")
    links = block.linked / max(1, size)
    out.append(f"words:{min(7, words.bit_length())}")
    out.append(f"links:{min(4, int(4 * links + 0.5))}")
    out.append("ends:" + (text[-1] if text[-1] in ".!?:," else "-"))
    if "©" in text:
        out.append("copyright")
    if place == 0:
        out.append("first")
    if place == count - 1:
        out.append("last")
    return sorted(set(out))


@dataclass
class Field:
    """Weights: features for the label main, label pairs, and the first label."""

    number: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray  # [label before, label]
    first: np.ndarray

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The best labelling of a page's blocks, by Viterbi."""
        if not blocks:
            return []
        score = np.zeros((len(blocks), 2))
        for t, block in enumerate(blocks):
            known = [self.number[f] for f in block_features(block, t, len(blocks)) if f in self.number]
            score[t, 1] = self.weights[known].sum()
        back = []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b = (self.first + score[0]).tolist()
        for s0, s1 in score[1:].tolist():
            to0, to1 = (0, a + p00) if a + p00 >= b + p10 else (1, b + p10), (
                (0, a + p01) if a + p01 > b + p11 else (1, b + p11)
            )
            back.append((to0[0], to1[0]))
            a, b = to0[1] + s0, to1[1] + s1
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return [bool(x) for x in reversed(labels)]


def train_field(pages: list[tuple[str, list[bool]]]) -> Field:
    """Maximum likelihood with a square penalty, all pages at once."""
    parsed = [(leaf_blocks(page), labels) for page, labels in pages]
    number: dict[str, int] = {}
    longest = max(len(labels) for _, labels in parsed)
    n = len(parsed)
    of_block, of_feature = [], []
    gold = np.zeros((n, longest), np.int64)
    present = np.zeros((n, longest), bool)
    for i, (blocks, labels) in enumerate(parsed):
        if len(blocks) != len(labels):
            raise ValueError(f"page {i} has {len(blocks)} blocks and {len(labels)} labels")
        present[i, : len(labels)] = True
        gold[i, : len(labels)] = labels
        for t, block in enumerate(blocks):
            for f in block_features(block, t, len(blocks)):
                of_block.append(i * longest + t)
                of_feature.append(number.setdefault(f, len(number)))
    of_block, of_feature = np.array(of_block), np.array(of_feature)
    size = len(number)
    theta = np.zeros(size + 6)  # features, pairs, first
    both = present[:, 1:]
    gold_pairs = np.bincount((gold[:, :-1] * 2 + gold[:, 1:])[both], minlength=4).astype(float)
    gold_first = np.bincount(gold[:, 0], minlength=2).astype(float)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        pairs, first = theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = np.bincount(of_block, weights=theta[of_feature], minlength=n * longest).reshape(n, longest)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = first + score[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp.reduce(forward[:, t - 1, :, None] + pairs, axis=1) + score[:, t]
            forward[:, t] = np.where(present[:, t, None], moved, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = np.logaddexp.reduce(pairs + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(present[:, t + 1, None], moved, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward + backward - total[:, None, None])
        together = np.exp(
            forward[:, :-1, :, None]
            + pairs
            + (score[:, 1:] + backward[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        )
        miss = np.where(present, gold - chance[:, :, 1], 0).ravel()
        gradient = np.concatenate(
            [
                np.bincount(of_feature, weights=miss[of_block], minlength=size),
                gold_pairs - together[both].sum(axis=0).ravel(),
                gold_first - chance[:, 0].sum(axis=0),
            ]
        )
        gradient = gradient / n - PENALTY * theta
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient**2 - v)
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(number, theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :])


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, main in zip(blocks, field.decode(blocks), strict=True) if main)


def extracted(df: DataFrame, field: Field, page: Column) -> Column:
    """The main text of a column of pages of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        trained = shared.value
        return pa.array([main_text(p.as_py() or "", trained) for p in pages], pa.string())

    return extract(F.coalesce(page, F.lit("")))


def with_main_text(df: DataFrame, html_col: str = "html", into: str = "text", field: Field | None = None) -> DataFrame:
    """``df`` with the main text of its pages."""
    field = field or train_field(labelled_pages(TRAINING_PAGES))
    return df.withColumn(into, extracted(df, field, column(df, html_col)))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = with_main_text(pages).drop("html")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
