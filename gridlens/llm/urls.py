"""URL filters: path rules, and for the rest a logistic regression on hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import groups_of, mix

#: Fixed values: (verdict, rule). A rule is host/path-prefix; the longest that fits wins.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: The labelled table, urls of unwanted sites (gambling, adult, drugs, loans, copies, trackers, traps, spam) ...
UNWANTED = """
http://www.royal-casino.bet/slots/bonus
https://casinolux24.com/en-gb/live-roulette
http://bestcasinos.info/review?id=44
https://play.goldencasino.net/jackpot/spin.php
https://casino-king.org/
http://poker-stars-free.biz/signup.html
https://www.holdempoker.win/tables/9
https://sportsbets365.co/odds/football
http://bet-now.tk/deposit
https://onlinebetting.club/free-bet/claim
https://m.betway-mirror.ru/line/4412
http://freebets4u.com/tips/today
https://bets-of-the-day.net/
https://luckyslots777.xyz/game/88
http://mega-win-jackpot.top/prize
https://you-win-big.info/lottery/claim.php
https://lottowinner.click/winners
http://win-iphone.club/free-prize
https://bingo-bonus.online/join
http://www.xxxtube.sex/watch/19283
https://adult-cams.live/room/kitty
https://hot-adult-video.net/free/hd
http://adultfriend.date/profile/77
https://www.pornhive.xxx/category/new
http://freeporn4all.ru/clips.html
https://sexy-girls-chat.com/webcam
http://nude-pics.info/gallery/12/
https://escort-berlin.net/girls/anna
http://camgirls.live/show?room=5
https://erotic-massage.biz/book
https://xxx-movies.top/play/3
http://milf-dating.online/meet
https://cheap-viagra.pharmacy/order
http://viagra-online-store.com/buy-now
https://cialis-generic.net/cheap/20mg
http://www.buycheappills.com/xanax
https://pills4less.biz/cart
https://diet-pills-fast.com/lose-weight
http://no-prescription-pharma.ru/tramadol
https://rxmeds-cheap.info/shop/pills
http://steroids-shop.to/catalog
https://replica-watches.cn/rolex
http://cheap-handbags-outlet.top/louis
https://fake-id-cards.org/order
http://discount-nike-cheap.shop/sale
https://payday-loans-now.com/apply
http://quickloan24.net/no-credit-check
https://cash-advance-fast.info/form
https://bad-credit-loans.biz/approve
http://earn-money-fast.online/work-from-home
https://bitcoin-doubler.club/invest
http://crypto-profit-robot.info/register
https://forex-signals-rich.com/vip
https://get-rich-quick.biz/secret
http://torrentz-movies.to/download/2291
https://crackedsoft.net/photoshop-keygen
http://warez-world.org/apps/full
https://keygen-serials.ru/crack/office
http://free-mp3-download.cc/album
https://movies-torrent.pw/magnet
http://nulled-scripts.top/theme.zip
https://ads.clickserve.net/banner?z=1
http://adserver.media-buy.com/ads/show.js
https://ads-network.biz/pop
http://track.adclicks.info/c/99182
https://tracker.leadpixel.io/track/event
http://click-track.net/redirect?u=1
https://popunder-ads.com/serve
https://trackingpixels.org/t.gif
http://doubleads.top/ad/frame.html
https://ad-track-metrics.com/collect
http://secure-paypa1-login.com/verify
https://account-verify-bank.info/update
http://appleid-locked.support/signin.php
https://webmail-quota.tk/login
http://free-antivirus-scan.club/alert
https://your-pc-infected.top/fix
http://flashplayer-update.click/setup.exe
https://malware-drop.ru/payload.bin
http://spam-links.info/page/991
https://linkfarm-seo.biz/backlinks
http://spamblog.top/cheap-seo
https://buy-backlinks-cheap.com/pr9
http://seo-spam-tools.net/xrumer
https://articlespam.info/post/1
http://link-farm-directory.org/submit
https://spammy-farm.xyz/doorway
http://buy-followers-cheap.net/instagram
https://guestbook-spam.ru/poster
http://miracle-weight-loss.info/keto
https://psychic-love-spells.biz/call
http://clickbait-viral.top/shocking
https://hookup-tonight.date/local
http://free-gift-cards.win/survey
https://survey-reward.club/claim?id=8
"""

#: ... and of ordinary ones.
ORDINARY = """
https://www.citylibrary.org/catalogue/search
http://news.dailyherald.com/2021/04/politics/vote.html
https://en.openwiki.org/wiki/Photosynthesis
https://de.openwiki.org/wiki/Hamburg
https://docs.pylang.org/3/library/json.html
http://www.weather-service.gov/forecast/7day
https://university.edu/departments/history/
https://blog.gardening-notes.net/2019/tomatoes
https://recipes.homekitchen.com/soups/lentil
http://museum-modern-art.org/exhibitions/current
https://shop.bookhaven.co.uk/fiction/9780141
https://www.trainlines.de/fahrplan/berlin
http://m.sportsreport.com/scores/2020
https://forum.linuxhelp.org/t/boot-error/3312
https://github.io/projects/readme
https://www.scienceweekly.com/articles/black-holes
http://healthclinic.org/patients/appointments
https://travel.islandtours.com/guides/lisbon
https://www.lemondejournal.fr/culture/article_22.html
http://elpais-noticias.es/deportes/1234
https://store.outdoorgear.com/tents/two-person
https://photos.familyalbum.net/u/anna/2015
https://www.parliament.gov/bills/117/text
http://schooldistrict.k12.us/calendar
https://api.maps-service.com/v2/tiles/12/33
https://www.musicreview.com/albums/jazz/8
https://theatre-royal.org/whatson
http://chess-club.net/games/1972
https://cooking.magazine.it/ricette/pasta
https://www.bankofcity.com/personal/savings
http://airport-info.com/arrivals
https://carparts.direct/brakes/front
https://help.mailservice.com/faq/reset
https://developer.webstandards.org/css/flex
http://physics.institute.ac.uk/papers/2204
https://www.zoo-garden.de/tiere/elefant
https://hotel-seaside.com/rooms/double
https://jobs.engineering.com/listing/5561
http://www.poetry-archive.org/poet/keats
https://video.lectures.edu/course/6006
https://www.theguide.net/cinema/reviews
http://astronomy.club/observations/m31
https://farmersmarket.org/vendors
https://www.therapy-center.com/about
https://northern-trails.net/hikes/88
http://tech.gadgetnews.com/phones/review-12
https://www.lawfirm-smith.com/contact
https://children.storybooks.org/en/read/40
https://www.statistics.gov/data/2022/table-9
http://blog.thomas-reads.com/index.php?p=17
https://insurance.mutual.com/home
https://m.thenation.org/opinion/3001
http://ontheroad.travelblog.net/fr/lyon
https://www.charity-water.org/donate
https://craft.knitting.net/patterns/scarf
http://archive.openbooks.org/details/moby
https://www.townhall.us/permits
https://static.cdnfiles.net/img/logo.png
http://www.handel-haus.de/konzerte
https://software.updates.org/releases/4.2
https://wiki.gamers.net/strategy/chess
https://podcast.station.fm/episodes/120
http://hospital-north.org/visiting
https://quotes.literature.org/twain
https://www.realestate-local.com/listing/221
http://dentist-main-street.com/hours
https://bikes.cityshare.org/stations
https://www.orchestra.org/season/2023
http://genealogy.roots.net/surname/miller
https://dictionary.words.com/define/river
https://noticias.diario.es/economia/552
http://www.rathaus-stadt.de/de/buergeramt
https://www.mairie-ville.fr/fr/services
https://aquarium.org/animals/otter
http://ftp.mirror.edu/pub/gnu/
https://math.stackforum.com/questions/5521/limits
https://www.energy-agency.org/reports/solar
http://vintagecars.org/models/1957
https://news.worldservice.com/africa/7781
https://ticket.railway.jp/search
https://www.bakery-corner.com/menu
http://history-of-art.net/renaissance/42
https://patents.office.gov/doc/US1234
https://blog.data-science.io/post/regression
http://www.oceanography.org/tides/9
https://veterinary.clinic.net/cats
https://www.furniture-house.com/chairs/oak
http://cinema-paradiso.it/film/10
https://postoffice.com/track-parcel
https://reader.comics.net/series/3/page/2
http://thesis.repository.edu/handle/1/77
https://www.tennis-club.org/members
https://home.network.net/status
http://opera.house.org/tickets/winter
"""


def labelled() -> list[tuple[str, int]]:
    """The labelled table (url, 1 for unwanted)."""
    return [(u, 1) for u in UNWANTED.split()] + [(u, 0) for u in ORDINARY.split()]


def varied(table: Sequence[tuple[str, int]], each: int = 7) -> list[tuple[str, int]]:
    """The table, and each of its hosts again in `each` plain surroundings, so that these say nothing about the class."""
    heads, ends, paths = ("", "www.", "m.", "blog."), (".com", ".net", ".org", ".info"), ("/", "/index.html", "/en/31", "/fr/4502.html", "/de/77/", "/page/2", "/2023/post")
    out = list(table)
    for i, (url, y) in enumerate(table):
        name = re.sub(r"^(www|m|blog)\.", "", cut(url)[0]).rpartition(".")[0]
        out += [(f"http://{heads[j % 4]}{name}{ends[j // 4 % 4]}{paths[j % 7]}", y) for j in range(i * each, (i + 1) * each)]
    return out


def cut(url: str) -> tuple[str, str]:
    """host_path() for one url of the table."""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def features(hosts: Sequence[str], paths: Sequence[str], bits: int, sizes=(3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of every n-gram of bytes; host and path have features of their own."""
    rows, feats = [], []
    for kind, texts in enumerate((hosts, paths)):
        raw = [b"^" + t.encode("utf-8", "surrogatepass") + b"$" for t in texts]
        size = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(raw)), size)
        for n in sizes:
            m = len(data) - n + 1
            if m <= 0:
                continue
            key = np.full(m, n * 2 + kind, np.uint64)
            for j in range(n):
                key = key * np.uint64(257) + data[j : j + m]
            ok = row[:m] == row[n - 1 :]
            rows.append(row[:m][ok])
            feats.append((mix(key[ok]) >> np.uint64(64 - bits)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(feats)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def margins(w: np.ndarray, b: float, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
    """Mean-weight logit of each of n URLs."""
    s = np.bincount(rows, w[feats], n)
    return b + s / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))


def train(table: Sequence[tuple[str, int]], bits: int = 16, l2: float = 1e-3, steps: int = 300, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent; the table is small by contract and stays on the driver."""
    hosts, paths = zip(*(cut(u) for u, _ in table))
    y = np.array([v for _, v in table], float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    rows, feats = features(hosts, paths, bits)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-margins(w, b, rows, feats, len(y))))
        g = (p - y) * weight
        w -= rate * 10 * (np.bincount(feats, (g * scale)[rows], len(w)) + l2 * w / len(y))
        b -= rate * g.sum()
    return w, b


def judge_urls(pages: DataFrame, rules=RULES, table: Sequence[tuple[str, int]] | None = None, block_at: float = 0.6, bits: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict, score.

    Host and path are cut from the url by built-in functions; a null url or one without :// has
    empty ones. A rule fits its host and subdomains if the path starts with the rule's path; the
    longest decides. Where none fits, the model does: block if its probability (score) is block_at
    or more; of an empty host and path it knows the classes' balance alone. Ties cannot arise, as rules are distinct. Repeated rows each get their row, null page_id stays,
    an empty table yields no rows, other columns aren't read. A long url is read whole, some bytes at a time. No shuffle; the model's 2^bits weights
    are broadcast, a fixed size.
    """
    host, path = host_path(F.col("url").cast("string"))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: len(x[1])):  # a longer rule goes before a shorter one
        rh, slash, rp = r.partition("/")
        fits = ((F.col("host") == rh) | F.col("host").endswith("." + rh)) & F.col("path").startswith(slash + rp)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, what).otherwise(verdict)
    w, b = train(varied(labelled() if table is None else table), bits)
    model = pages.sparkSession.sparkContext.broadcast((w, b))

    @F.pandas_udf("double")
    def score(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w, b = model.value
        for h, p in it:
            out = []
            for i, j in groups_of(pa.array(h + p, pa.string()), 1_000_000):
                rows, feats = features(h[i:j].tolist(), p[i:j].tolist(), bits)
                out.append(1 / (1 + np.exp(-margins(w, b, rows, feats, j - i))))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    d = d.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("score", score("host", "path"))
    by_model = F.when(F.col("score") >= block_at, "block").otherwise("allow")
    return d.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
