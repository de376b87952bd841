"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
NGRAMS = (3, 4, 5)
#: Labelled rows that a fit takes at most; the first by url, so the choice doesn't depend on partitions.
MAX_LABELLED = 10_000

# Words of hosts and paths that a crawl blocks, and of ordinary ones, among them ordinary words that resemble blocked ones.
BLOCKED_WORDS = """
casino casinos online-casino poker pokerstars bet bets betting sportsbet sportsbook bookmaker slot slots jackpot roulette blackjack bingo lottery lotto gamble gambling win-cash spin-win
pill pills viagra cialis levitra pharma-cheap cheap-meds cheap-pills meds-online no-prescription rx-pharmacy steroids weight-loss-pills
adult adult-cam adult-video adult-chat adult-toys adultfriends xxx porn porno pornhub escort escorts sex sex-cams sexshop sexy nude nudes naked-girls webcam-girls hot-dates hookup milf hentai erotic
ads ads-server ads-network ad-track adserver adclick banner-ads tracker click-track pixel-track popunder popads
spam spam-farm link-farm seo-links buy-backlinks free-money free-bets get-rich make-money-fast payday-loans quick-loan instant-credit bitcoin-doubler crypto-giveaway
replica-watches fake-bags buy-rolex cheap-rolex replica-shoes warez cracks crack-keygen keygen serials torrent-free malware phish-login verify-account-login free-iphone
""".split()
ORDINARY_WORDS = """
news blog docs wiki library museum university school science garden kitchen travel history music weather sports city council bank hospital research journal forum photos maps books recipes support
community archive tutorial review market theatre energy nature health parents winter letter water pattern station nation motion theory reader anthem tension other father mother north thing inner shelter tissue
download downloads betty better alphabet crocker betty-crocker adults-literacy adulthood essex sussex middlesex sexton unisex-clothing scunthorpe analysis assets class classes cocktail therapist grape grapes
pillow pillows pillar caterpillar slotted timeslots loader address adapter advice advent adventure headset gradient roads loads leads tracks tracking-parcel racetrack backpack cracker crackers crackle nudge nuden spamalot
medicine pharmacy-school pharmacology escortion porncic poke pokemon potter pottery lotion allotment bingley gamble-family gamma rolexander replicate replica-museum torrential moneybox credit-union loan-library watches clockmaker
about contact product products category article articles event events gallery video videos shop store help faq status api developer user users profile project projects issue release theme design art film radio magazine
hotel restaurant coffee bakery farm forest mountain lake island ocean harbour bridge castle church temple market-hall railway airport bicycle football tennis chess rowing sailing yoga dance choir orchestra opera
""".split()
PREFIXES = ("", "www.", "m.", "blog.")
ENDINGS = ("example.com", "example.org", "example.net")
PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}?page=2&ref=x", "/{}", "")


def labelled_urls() -> list[tuple[str, int]]:
    """A small labelled table, made from the words by rule: each word as a host, alone and joined to another, and as a path of a neutral host."""
    out = []
    for label, words in ((1, BLOCKED_WORDS), (0, ORDINARY_WORDS)):
        for i, word in enumerate(words):
            other = words[(i * 7 + 3) % len(words)]
            for k, host in enumerate((word, f"{word}-{other}", f"{other}{word}")):
                path = PATHS[(i + k) % len(PATHS)].format(100 + 37 * i)
                out.append((f"http{'s' * (i % 2)}://{PREFIXES[(i + k) % 4]}{host}.{ENDINGS[(i + 2 * k) % 3]}{path}", label))
            out.append((f"https://site{i}.{ENDINGS[i % 3]}/{word}/{i}", label))
            out.append((f"https://{PREFIXES[i % 4]}{ORDINARY_WORDS[i % len(ORDINARY_WORDS)]}.{ENDINGS[i % 3]}{PATHS[i % 5].format(i * 911)}", 0))
    # ordinary hosts of joined syllables
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    for i in range(300):
        host = "".join(syllables[(i * a + b) % len(syllables)] for a, b in ((7, 1), (11, 5), (13, 8))[: 2 + i % 2])
        out.append((f"http{'s' * (i % 2)}://{PREFIXES[i % 4]}{host}.{ENDINGS[i % 3]}{PATHS[i % 6].format(i * 173)}", 0))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to /, ? or #, with A-Z lower-cased; then up to ? or #. Both empty for null and for a url without ://."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits.

    rules: (host and path as one string, verdict), a short list. Of equally long fitting
    rules, which only repeated rules can be, the first stands.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the character n-grams of host and path."""
    found = set()
    for mark, text in (("h", f".{host}."), ("p", path)):
        for n in NGRAMS:
            found.update(zlib.crc32(f"{mark}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(text) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def fit(labelled: DataFrame, *, max_rows: int = MAX_LABELLED, rounds: int = 200, rate: float = 10.0, penalty: float = 1e-4) -> np.ndarray:
    """Weights (one per bucket, and a constant that is 0 but for useless tables) from (url, label 0 or 1). Rows with nulls are left out; without rows of both labels the weights allow everything. Of more than max_rows rows the first by url and label are taken; repeated rows count as often as they stand; other columns are ignored."""
    host, path = split_url(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(host.alias("host"), path.alias("path"), F.col("label").cast("int"), "url").orderBy("url", "label").limit(max_rows).collect()
    w = np.zeros(BUCKETS + 1)
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y)) < 2:
        w[-1] = -1.0
        return w
    found = [features(r["host"], r["path"]) for r in rows]
    size = np.fromiter(map(len, found), np.int64, len(found))
    row, at = np.repeat(np.arange(len(rows)), size), np.concatenate(found)  # the matrix by its entries, each 1 / sqrt(row's entries)
    value = (1 / np.sqrt(np.maximum(1, size)))[row]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[at], len(rows)), -30, 30)))
        speed = 0.9 * speed - rate * (np.bincount(at, value * (weight * (p - y))[row], len(w)) + penalty * w)
        w = w + speed
    return w


def judge_urls(pages: DataFrame, weights: np.ndarray, rules: Sequence[tuple[str, str]] = (), *, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (probability to block).

    A fitting rule decides; else a score of threshold or more blocks. A url without an
    n-gram, such as one without ://, gives no reason to block and is allowed. Ids may be null or repeat; other columns are
    ignored; an empty table gives an empty result.
    """
    small = weights.astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.full(len(pdf), small[-1] - 1e-9)
            for i, (host, path) in enumerate(zip(pdf["host"], pdf["path"], strict=True)):
                at = features(host, path)
                if len(at):
                    z[i] += small[at].sum() / np.sqrt(len(at))
            yield pdf.assign(score=1 / (1 + np.exp(-np.clip(z, -500, 500)))).astype({"page_id": "Int64"})

    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = parts.mapInPandas(run, "page_id long, host string, path string, score double")
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, model).alias("verdict"), "score")
