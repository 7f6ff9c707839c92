"""Identity of URLs and posts. What is no http(s) URL has the empty key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import collapse

# The digits of a shortcode in order, and the epochs that ids count from.
SHORTCODE_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
SHORTCODE_EPOCH_MS, SHORTCODE_SHIFT, VIDEO_SHIFT = 1314220021300, 8388608, 4294967296
# Query parameters that only track.
TRACKING = r"^(?:utm_[a-z_]*|igsh[a-z]*|fbclid|gclid|mc_[a-z]+)="


def is_http(url: Column) -> Column:
    return collapse(url).rlike("(?i)^https?://")


def host(url: Column) -> Column:
    """The host in lower case without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(collapse(url), r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(collapse(url), r"(?i)^https?://[^/?#]+([^?#]*)", 1)


def parameter(url: Column, name: str) -> Column:
    return F.regexp_extract(collapse(url), rf"[?&]{name}=([^&#]*)", 1)


def registered_name(url: Column) -> Column:
    """The label left of the top-level one."""
    return F.coalesce(F.try_element_at(F.split(host(url), r"\."), F.lit(-2)), F.lit(""))


def _unwrapped(url: Column) -> Column:
    """The page a login redirect leads to."""
    to = F.replace(F.replace(parameter(url, "next"), F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":"))
    full = F.when(to.rlike("(?i)^https?://"), to).otherwise(F.concat(F.lit("https://instagram.com/"), F.regexp_replace(to, "^/+", "")))
    return F.when(path(url).rlike("(?i)^/accounts/login/?$") & (to != ""), full).otherwise(collapse(url))


def _post_code(url: Column, kinds: str) -> Column:
    at = F.regexp_replace(host(url), r"^m\.", "") == "instagram.com"
    return F.when(at, F.regexp_extract(path(url), rf"(?i)/(?:{kinds})/+([A-Za-z0-9_-]+)", 1)).otherwise("")


def post_key(url: Column) -> Column:
    """instagram:CODE, the same for a post and a reel; the code keeps its case."""
    code = _post_code(_unwrapped(url), "p|reel|reels|tv")
    return F.when(code != "", F.concat(F.lit("instagram:"), code)).otherwise("")


def queue_post_key(url: Column) -> Column:
    """The queue's key, which keeps the kind of post and knows no reels."""
    kind = F.lower(F.regexp_extract(path(url), r"(?i)/(p|reel|tv)/+[A-Za-z0-9_-]+", 1))
    code = _post_code(url, "p|reel|tv")
    return F.when(code != "", F.concat_ws(":", F.lit("instagram"), kind, code)).otherwise("")


def social_key(url: Column) -> Column:
    video = F.when(host(url).endswith("tiktok.com"), F.lower(F.regexp_extract(path(url), r"(?i)/video/+([^/]+)", 1))).otherwise("")
    return F.coalesce(F.nullif(post_key(url), F.lit("")), F.when(video != "", F.concat(F.lit("tiktok:video:"), video)), F.lit(""))


def deal_url(url: Column) -> Column:
    """The post key, or the advert's id, or the URL in lower case without www, query, fragment and last slashes."""
    advert = F.when(host(url).rlike(r"(?:^|\.)facebook\.com$") & path(url).rlike(r"(?i)^/ads/(?:library/?|archive/render_ad/?)"), F.regexp_replace(parameter(url, "id"), "[^A-Za-z0-9._-]", "")).otherwise("")
    scheme = F.lower(F.regexp_extract(collapse(url), r"(?i)^(https?)://", 1))
    port = F.regexp_extract(collapse(url), r"(?i)^https?://[^/?#:]+(:[0-9]+)", 1)
    plain = F.concat(scheme, F.lit("://"), host(url), port, F.lower(F.regexp_replace(path(url), "/+$", "")))
    plain = F.when(F.regexp_replace(path(url), "/+$", "") == "", F.concat(plain, F.lit("/"))).otherwise(plain)
    return F.when(~is_http(url), "").when(post_key(url) != "", post_key(url)).when(advert != "", F.concat(F.lit("meta-ad:"), advert)).otherwise(plain)


def without_fragment(url: Column) -> Column:
    return F.when(is_http(url), F.regexp_replace(F.regexp_replace(collapse(url), "#.*$", ""), "/+$", "")).otherwise("")


def without_tracking(url: Column) -> Column:
    """The URL without its fragment and its tracking parameters; others stay in order."""
    query = F.regexp_extract(collapse(url), r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.lower(kv).rlike(TRACKING)), "&")
    base = F.regexp_replace(collapse(url), "[?#].*$", "")
    return F.when(is_http(url), F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))).otherwise("")


def shortcode_number(code: Column) -> Column:
    """A shortcode as the number its digits to base 64 make; null if a character is no digit."""
    digits = F.split(code, "")
    number = F.aggregate(digits, F.lit(0).cast("decimal(38,0)"), lambda n, c: (n * 64 + F.position(c, F.lit(SHORTCODE_DIGITS)) - 1).cast("decimal(38,0)"))
    return F.when(code.rlike("^[A-Za-z0-9_-]{5,20}$"), number)


def shortcode_time(code: Column) -> Column:
    """The moment a post's shortcode was made; null before 2011."""
    ms = (F.floor(shortcode_number(code) / SHORTCODE_SHIFT) + SHORTCODE_EPOCH_MS).cast("bigint")
    return F.when(ms >= 1293840000000, F.timestamp_millis(ms))


def video_time(number: Column) -> Column:
    """The moment a video id of 16 to 22 digits was made; null before 2016."""
    seconds = F.floor(F.when(number.rlike("^[0-9]{16,22}$"), number).cast("decimal(38,0)") / VIDEO_SHIFT).cast("bigint")
    return F.when(seconds >= 1451606400, F.timestamp_seconds(seconds))
