"""Ids, hosts and names in video links and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a link or a page names its video, in order of preference.
PATHS = (r"/video/(\d{5,25})", r"/photo/(\d{5,25})", r"/share/video/(\d{5,25})", r"/i18n/share/video/(\d{5,25})", r"/embed/(?:v2/)?(\d{5,25})")
QUERY_KEYS = ("aweme_id", "awemeId", "item_id", "itemId", "share_item_id", "shareItemId", "video_id", "videoId")
IN_PAGE = (
    r'"(?:aweme_id|awemeId|item_id|itemId|share_item_id|shareItemId|video_id|videoId)"\s*[:=]\s*"?(\d{5,25})"?',
    r"(?:aweme_id|item_id|share_item_id|video_id)=([0-9]{5,25})",
    r'"ItemModule"\s*:\s*\{\s*"(\d{5,25})"\s*:',
    r"https://www\.tiktok\.com/@[^\"']+/(?:video|photo)/(\d{5,25})",
    r"/(?:video|photo)/(\d{5,25})",
)
# Hosts of shortened links and of pages.
SHORT_HOSTS = ("vt.tiktok.com", "vm.tiktok.com", "t.tiktok.com")
PAGE_HOSTS = ("www.tiktok.com", "m.tiktok.com")
SITE = "tiktok"


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def _unquoted(text: Column) -> Column:
    """Percent-decoded; a plus sign stays one, and what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)


def video_id(url: Column) -> Column:
    """Id in the path, else the first query value of 5 to 25 digits; empty if there is none or url is null."""
    clean = F.trim(F.coalesce(url, F.lit("")))
    by_key = [F.nullif(F.regexp_extract(clean, rf"[?&]{k}=(\d{{5,25}})(?:[&#]|$)", 1), F.lit("")) for k in QUERY_KEYS]
    return F.coalesce(_first(_unquoted(clean), PATHS), *by_key, F.lit(""))


def host(url: Column) -> Column:
    """Lower-cased host without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def is_short(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return host(url).isin(*SHORT_HOSTS) | (host(url).isin(*PAGE_HOSTS) & path.startswith("/t/"))


def video_id_in_page(page: Column) -> Column:
    plain = F.replace(F.replace(_unquoted(F.coalesce(page, F.lit(""))), F.lit("\\u002F"), F.lit("/")), F.lit("\\/"), F.lit("/"))
    return F.coalesce(_first(plain, IN_PAGE), F.lit(""))


def username(url: Column) -> Column:
    found = F.regexp_extract(_unquoted(F.coalesce(url, F.lit(""))), r"/@([^/?#]+)", 1)
    return F.when(found == "", F.lit(SITE)).otherwise(F.regexp_replace(found, r"^@+|@+$", ""))


def canonical(video: Column, source: Column) -> Column:
    name = username(source)
    return F.concat(F.lit(f"https://www.{SITE}.com/@"), F.when(name == "", F.lit(SITE)).otherwise(name), F.lit("/video/"), video)
