"""URL functions: repair, normal form, hash, and what a URL tells about its page.

Every function takes a string expression and a dialect and gives an expression; nulls give nulls. The
normal form is lossy by design: it is for comparing pages, not for fetching them.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import Any

from broadsheet.functions import encoding, hosts
from broadsheet.plans.dialect import SPARK, SPARK_SQL, Form, rewritten, stripped

# ---- fixed values: hashes and predicates depend on them to the letter ----

#: Query parameters that are always dropped.
DROPPED_PARAMETERS = (
    "fb_action_ids", "fb_action_types", "fb_source", "fb_ref", "action_object_map", "action_type_map", "action_ref_map", "fsrc_fb_noscript", "yclid",
    "_openstat", "sortPHPSESSID", "PHPSESSIONID", "cid", "s_cid", "sid", "ncid", "ir", "ref", "oref", "eref", "ns_mchannel", "ns_campaign", "ITO",
    "wprss", "custom_click", "source", "feedName", "feedType", "skipmobile", "skip_mobile", "altcast_code",
)
#: Those that are dropped where the host has a certain string in it.
DROPPED_ON_HOST = {
    "facebook.com": ["ref", "fref", "hc_location"],
    "nytimes.com": ["emc", "partner", "_r", "hp", "inline", "smid", "WT.z_sma", "bicmp", "bicmlukp", "bicmst", "bicmet", "abt", "abg"],
    "livejournal.com": ["thread", "nojs"],
    "google.": ["gws_rd", "ei"],
}
#: First labels of hosts that are taken off, with one character more if there is one.
DROPPED_LABELS = "m|beta|media|data|image|www|cdn|topic|article|news|archive|blog|video|search|preview|login|shop|sports?|act|donate|press|web|photos?|\\d+?"
#: Sites that carry no news.
NON_NEWS_DOMAINS = (
    "archive.org", "archive.ph", "booking.com", "etsy.com", "flickr.com", "goodreads.com", "iheart.com", "imdb.com", "instagram.com", "linkedin.com",
    "pinterest.com", "slideshare.net", "tiktok.com", "twitter.com", "whatsapp.com", "wikidata.org", "wikimedia.org", "wikipedia.org", "youtube.com",
)
#: Hosts that only shorten URLs, unless another list is given. They are compared whole, so that those beginning or ending in a dot meet no host.
SHORTENERS = (
    ".tk", "0rz.tw", "1link.in", "1url.com", "2.gp", "2big.at", "2pl.us", "2tu.us", "2ya.com", "3.ly", "307.to", "4ms.me", "4sq.com", "4url.cc",
    "6url.com", "7.ly", "a.gg", "a.nf", "a2a.me", "aa.cx", "abbrr.com", "abcurl.net", "ad.vu", "adf.ly", "adjix.com", "afx.cc", "all.fuseurl.com",
    "alturl.com", "amzn.to", "ar.gy", "archive.is", "arst.ch", "atu.ca", "azc.cc", "b23.ru", "b2l.me", "bacn.me", "bcool.bz", "binged.it", "bit.ly",
    "bizj.us", "bkite.com", "bloat.me", "bloom.bg", "bravo.ly", "bsa.ly", "budurl.com", "buk.me", "burnurl.com", "c-o.in", "c212.net", "canurl.com",
    "chilp.it", "chzb.gr", "cl.lk", "cl.ly", "clck.ru", "cli.gs", "cliccami.info", "clickmeter.com", "clickthru.ca", "clop.in", "conta.cc", "cort.as",
    "cot.ag", "crks.me", "ctvr.us", "cutt.us", "cuturl.com", "dai.ly", "decenturl.com", "dfl8.me", "digbig.com", "digg.com", "disq.us", "dld.bz",
    "dlvr.it", "do.my", "doiop.com", "dopen.us", "dwarfurl.com", "dy.fi", "easyuri.com", "easyurl.net", "eepurl.com", "esyurl.com", "eweri.com",
    "ewerl.com", "fa.b", "fa.by", "fav.me", "fb.me", "fbshare.me", "feeds.feedburner.com", "ff.im", "fff.to", "fhurl.com", "fire.to", "firsturl.de",
    "firsturl.net", "flic.kr", "flq.us", "fly2.ws", "fon.gs", "freak.to", "fuseurl.com", "fuzzy.to", "fwd4.me", "fwib.net", "g.ro.lt", "gizmo.do",
    "gl.am", "go.9nl.com", "go.ign.com", "go.usa.gov", "go2.me", "go2cut.com", "goo.gl", "goshrink.com", "gowat.ch", "gri.ms", "gurl.es",
    "hellotxt.com", "hex.io", "hiderefer.com", "hmm.ph", "hover.com", "href.in", "hsblinks.com", "htxt.it", "huff.to", "hugeurl.com", "hulu.com",
    "hurl.it", "hurl.me", "hurl.ws", "icanhaz.com", "idek.net", "ihe.art", "ilix.in", "inreply.to", "is.gd", "iscool.net", "iterasi.net", "its.my",
    "ix.lt", "j.mp", "jijr.com", "jmp2.net", "just.as", "kissa.be", "kl.am", "klck.me", "korta.nu", "krunchd.com", "l9k.net", "lat.ms", "liip.to",
    "liltext.com", "lin.cr", "linkbee.com", "linkbun.ch", "liurl.cn", "ln-s.net", "ln-s.ru", "lnk.gd", "lnk.in", "lnk.ms", "lnkd.in", "lnkurl.com",
    "loopt.us", "lru.jp", "lt.tl", "lurl.no", "macte.ch", "mash.to", "merky.de", "metamark.net", "migre.me", "minilien.com", "miniurl.com",
    "minurl.fr", "mke.me", "moby.to", "moourl.com", "mrte.ch", "myloc.me", "myurl.in", "n.pr", "nbc.co", "nblo.gs", "ne1.net", "njx.me", "nn.nf",
    "not.my", "notlong.com", "nsfw.in", "nutshellurl.com", "nxy.in", "nyti.ms", "o-x.fr", "oc1.us", "om.ly", "omf.gd", "omoikane.net", "on.cnn.com",
    "on.mktw.net", "onforb.es", "orz.se", "ow.ly", "pd.am", "pic.gd", "ping.fm", "piurl.com", "pli.gs", "pnt.me", "politi.co", "poprl.com", "post.ly",
    "posted.at", "pp.gg", "profile.to", "ptiturl.com", "pub.vitrue.com", "qicute.com", "qlnk.net", "qte.me", "qu.tc", "quip-art.com", "qy.fi", "r.im",
    "rb6.me", "read.bi", "readthis.ca", "reallytinyurl.com", "redir.ec", "redirects.ca", "redirx.com", "retwt.me", "ri.ms", "rickroll.it", "riz.gd",
    "rsmonkey.com", "rt.nu", "ru.ly", "rubyurl.com", "rurl.org", "rww.tw", "s4c.in", "s7y.us", "safe.mn", "sameurl.com", "sdut.us", "shar.es",
    "sharein.com", "sharetabs.com", "shink.de", "shorl.com", "short.ie", "short.to", "shortlinks.co.uk", "shortna.me", "shorturl.com", "shoturl.us",
    "shout.to", "show.my", "shrinkify", "shrinkify.com", "shrinkr.com", "shrinkster.com", "shrt.fr", "shrt.st", "shrten.com", "shrunkin.com",
    "shw.me", "simurl.com", "slate.me", "smallr.com", "smsh.me", "smurl.name", "sn.im", "snipr.com", "snipurl.com", "snurl.com", "sp2.ro",
    "spedr.com", "sqrl.it", "srnk.net", "srs.li", "starturl.com", "sturly.com", "su.pr", "surl.co.uk", "surl.hu", "t.cn", "t.co", "t.lh.com", "ta.gd",
    "tbd.ly", "tcrn.ch", "tgr.me", "tgr.ph", "thrdl.es", "tighturl.com", "tiniuri.com", "tiny.cc", "tiny.ly", "tiny.pl", "tiny123.com", "tinyarro.ws",
    "tinylink.in", "tinytw.it", "tinyuri.ca", "tinyurl.com", "tinyvid.io", "tk.", "tl.gd", "tmi.me", "tnij.org", "tnw.to", "tny.com", "to.", "to.ly",
    "togoto.us", "totc.us", "toysr.us", "tpm.ly", "tr.im", "tr.my", "tra.kz", "traceurl.com", "trib.al", "trunc.it", "turo.us", "tweetburner.com",
    "tweetphoto", "twhub.com", "twirl.at", "twit.ac", "twitclicks.com", "twitterpan.com", "twitterurl.net", "twitterurl.org", "twitthis.com",
    "twiturl.de", "twurl.cc", "twurl.nl", "u.mavrev.com", "u.nu", "u6e.de", "u76.org", "ub0.cc", "ulu.lu", "updating.me", "ur1.ca", "url.az",
    "url.co.uk", "url.ie", "url360.me", "url4.eu", "urlao.com", "urlborg.com", "urlbrief.com", "urlcover.com", "urlcut.com", "urlenco.de",
    "urlhawk.com", "urli.nl", "urlkiss.com", "urlot.com", "urlpire.com", "urls.im", "urlshorteningservicefortwitter.com", "urlx.ie", "urlx.org",
    "urlzen.com", "usat.ly", "use.my", "vb.ly", "vgn.am", "virl.com", "vl.am", "vm.lc", "w3t.org", "w55.de", "wapo.st", "wapurl.co.uk", "wipi.es",
    "wp.me", "x.se", "x.vu", "xaddr.com", "xeeurl.com", "xr.com", "xrl.in", "xrl.us", "xurl.es", "xurl.jp", "xzb.cc", "y.ahoo.it", "yatuc.com",
    "ye.pe", "yep.it", "yfrog.com", "yhoo.it", "yiyd.com", "youtu.be", "yuarel.com", "yweb.com", "z0p.de", "zi.ma", "zi.mu", "zi.pe", "zipmyurl.com",
    "zud.me", "zurl.ws", "zz.gd", "zzang.kr", "›.ws", "✩.ws", "✿.ws", "❥.ws", "➔.ws", "➞.ws", "➡.ws", "➨.ws", "➯.ws", "➹.ws", "➽.ws",
)

_WORD = r"[\p{L}\p{N}_]"
#: What people get wrong in URLs, and what stands there instead, in the order in which it is done.
REPAIRS = (
    (r"(?i)(https?://)https?:?//", "$1"),
    (rf"(?i)(https?:/)({_WORD})", "$1/$2"),
    (r"^//", "http://"),
    (r"\\", "/"),
    (r"(?i)^(https?://[\p{L}\p{N}_.-]+):($|/)", "$1$2"),
    (r"(?i)(https?://[^/]+)\?", "$1/?"),
    (" ", "%20"),
)
#: YouTube's pages: of videos, embedded videos, channels, and the rest.
_YOUTUBE = r"(?i)^https?://[^/]*youtube.com/"
_YOUTUBE_FORMS = (("watch?v=", r"watch\?v=([^&]+)"), ("watch?v=", r"embed/([^?]+)"), ("channel/", r"channel/([^?]+)"), ("", r"(.*)"))
#: Archived pages, whose own URL comes after the archive's.
_ARCHIVED = "(?i)^https://archive.is/[a-z0-9]/[a-z0-9]+/(.*)"
#: Rewrites of the normal form, after the first label is taken off.
_REWRITES = ((r"(?i)http://.*pron.*\.podomatic\.com", "http://pronkpops.podomatic.com"), ("#.*", ""), ("(//.*/)/+", "$1"), ("(?i)^https:", "http:"))
#: What a shortener's URL looks like, and the path of a front page.
_SHORT = r"(?i)^https?://[a-z]{1,4}\.[a-z]{2}/[a-z0-9]{3,12}/?$"
_FRONT = r"^$|^/+$|^[a-z/_-]{1,18}/?$|^[A-Z/_-]{1,18}/?$"

# ---- end of fixed values ----

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IP = rf"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?({_OCTET}(?:\.{_OCTET}){{3}})(?:[:/?#]|$)"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def fix_mistakes(url: Any, on: Any = SPARK) -> Any:
    """What people get wrong in URLs, put right."""
    return rewritten(stripped(url, on), REPAIRS, on)


def remove_port(url: Any, on: Any = SPARK) -> Any:
    """Without the port."""
    return on.replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*?):\d+([/?#]|$)", "$1$2")


def youtube(url: Any, on: Any = SPARK) -> Any:
    """One form for all URLs of a video or channel. The query of other YouTube pages, users' too, stays."""

    def form(u: Any) -> Any:
        part = lambda pattern: on.extract(u, _YOUTUBE + pattern, 1)
        to = lambda prefix, pattern: (on.test(u, _YOUTUBE + pattern), on.concat(on.lit(f"https://www.youtube.com/{prefix}"), part(pattern)))
        return on.case(*(to(*form) for form in _YOUTUBE_FORMS), other=u)

    return on.let(url, form)


def host(url: Any, on: Any = SPARK) -> Any:
    """The lower-cased host; null where the URL has none."""
    return on.lower(on.none_if(on.extract(url, _HOST, 1), ""))


def path(url: Any, on: Any = SPARK) -> Any:
    """From the host's end to the query or fragment."""
    return on.extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def ip_host(url: Any, on: Any = SPARK) -> Any:
    """The IPv4 address that a URL has for a host; null otherwise."""
    return on.none_if(on.extract(url, _IP, 1), "")


def strip_subdomain(url: Any, on: Any = SPARK) -> Any:
    """Without a first label that says nothing, but for addresses and hosts that redirect by label."""
    cut = lambda u: on.replace(u, rf"(?i)^(https?://)({DROPPED_LABELS}).?\.(.*\.)", "$1$3")
    keep = lambda u: on.either(on.test(u, _IP), on.has(u, on.lit("r2.ly")))
    return on.let(url, lambda u: on.case((keep(u), u), other=cut(u)))


def sort_query(url: Any, on: Any = SPARK) -> Any:
    """With the parameters in order."""
    parts = lambda u: on.join(on.sort(on.split(on.extract(u, r"\?(.*)$", 1), "&")), "&")
    return on.let(url, lambda u: on.case((on.test(u, r"\?."), on.concat(on.extract(u, r"^[^?]*\?"), parts(u))), other=u))


def remove_parameters(url: Any, on: Any = SPARK) -> Any:
    """Without the fragment and the parameters that only track or sort; without a query if none is left."""

    def body(u: Any) -> Any:
        at = host(u, on)
        tracked = lambda p: on.any(on.split(on.extract(u, r"\?(.*)$", 1), "&"), lambda q: on.test(q, "^nk=[0-9a-fA-F]+$")) if p else None

        def stays(parameter: Any) -> Any:
            name = on.extract(parameter, "^[^=]*")
            goes = [on.among(name, [*DROPPED_PARAMETERS, ""]), on.test(name, "^(_|ga_|utm_)"), on.both(on.same(name, on.lit("nk")), tracked(True))]
            goes += [on.both(on.has(at, on.lit(where)), on.among(name, names)) for where, names in DROPPED_ON_HOST.items()]
            return on.no(on.either(*goes))

        left = on.join(on.keep(on.split(on.extract(u, r"\?(.*)$", 1), "&"), stays), "&")
        base = on.extract(u, r"^[^?]*")
        return on.let(left, lambda q: on.case((on.same(q, on.lit("")), base), other=on.concat(base, on.lit("?"), q)))

    # a URL without a host has no parameters that we know how to judge
    return on.let(on.replace(url, "#.*", ""), lambda u: on.case((on.absent(host(u, on)), on.none_if(on.lit(""), "")), (on.test(u, r"\?"), body(u)), other=u))


def ascii_host(url: Any, on: Any = SPARK) -> Any:
    """With an international host in ASCII; see broadsheet.functions.hosts. In the other engine's SQL hosts stay as they are."""
    scheme, name, rest = r"^([a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?)", r"([^/?#@:]*)", r"((?s:.*))$"
    part = lambda u, i: on.extract(u, scheme + name + rest, i)
    return on.let(url, lambda u: on.case((on.test(u, scheme + r"[^/?#@]*[^\x00-\x7f/?#@]"), on.concat(part(u, 1), on.form(part(u, 2), hosts.ascii_form()), part(u, 3))), other=u))


def without_dots(url: Any, on: Any = SPARK) -> Any:
    """With a path without segments of dots."""
    return on.form(url, encoding.without_dots())


def percent(url: Any, on: Any = SPARK) -> Any:
    """Percent-encoding in normal form; see broadsheet.functions.encoding."""
    return on.form(on.form(url, encoding.decoded()), encoding.encoded())


def normalize(url: Any, on: Any = SPARK) -> Any:
    """The form under which URLs of one page compare equal; null for an empty one.

    Characters are decoded before letters are lower-cased, and those that may not stand in a URL encoded
    again after it, so that both spellings of a letter have one form.
    """
    return on.form(url, _normal_form()) if on is SPARK else _normalized(url, on)


@functools.lru_cache(1)
def _normal_form() -> Form:
    """The normal form as text, which Spark parses in a fraction of the time that as many calls to the JVM take."""
    return Form("x -> " + _normalized("x", SPARK_SQL))


def _normalized(url: Any, on: Any) -> Any:
    u = remove_port(fix_mistakes(on.none_if(url, ""), on), on)
    u = on.form(u, encoding.decoded())
    u = on.let(u, lambda x: on.case((on.test(x, _YOUTUBE), youtube(x, on)), other=on.lower(x)))
    u = on.replace(u, _ARCHIVED, "$1")
    u = on.let(u, lambda x: on.case((on.starts(x, on.lit("http")), x), other=on.concat(on.lit("http://"), x)))
    u = strip_subdomain(u, on)
    u = rewritten(u, _REWRITES, on)
    u = on.form(ascii_host(without_dots(u, on), on), encoding.encoded())
    u = sort_query(u, on)
    u = on.let(u, lambda x: on.case((on.test(x, "(?i)https?://[^/]*$"), on.concat(x, on.lit("/"))), other=x))
    return on.replace(on.swap(remove_parameters(u, on), "=&", "&"), "=$", "")


def url_hash(url: Any, on: Any = SPARK) -> Any:
    """What pages are de-duplicated by: the digest of the normal form."""
    return on.sha256(normalize(url, on))


def is_shortened(url: Any, on: Any = SPARK, shorteners: Sequence[str] = tuple(SHORTENERS)) -> Any:
    """Whether a URL looks like a shortener's: a known host, or a short host and a short path."""
    test = lambda u: on.case((on.absent(host(u, on)), on.same(on.none_if(on.lit(""), ""), on.lit(""))), (on.among(path(u, on), ["", "/"]), on.lit(False)), other=on.either(on.among(host(u, on), list(shorteners)), on.test(u, _SHORT)))
    return on.let(stripped(url, on), test)


def is_homepage(url: Any, on: Any = SPARK, shorteners: Sequence[str] = tuple(SHORTENERS)) -> Any:
    """Whether a URL looks like a front page: no path, or a short one in one case."""
    return on.let(stripped(url, on), lambda u: on.both(on.no(is_shortened(u, on, shorteners)), on.test(path(u, on), _FRONT)))


def is_non_news(name: Any, on: Any = SPARK) -> Any:
    """Whether a host is, or lies under, one of the sites that carry no news."""
    return on.test(on.lower(name), r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in NON_NEWS_DOMAINS) + ")$")


def feed_normalize(url: Any, on: Any = SPARK) -> Any:
    """The form under which URLs of one feed compare equal. Scheme-less ones keep their text as a path."""
    parts = r"^(?:([a-z][a-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

    def body(u: Any) -> Any:
        get = lambda i: on.extract(u, parts, i)
        scheme, place = get(1), get(2)
        bare = on.case((on.both(on.same(scheme, on.lit("https")), on.test(place, "^[^:]*:443$")), on.replace(place, ":443$", "")), (on.both(on.same(scheme, on.lit("http")), on.test(place, "^[^:]*:80$")), on.replace(place, ":80$", "")), other=place)
        trail = on.replace(on.replace(get(3), r"^(.*/[^/;]*|[^/;]*);[^/]*$", "$1"), "/$", "")
        query = on.join(on.sort(on.split(get(4), "&")), "&")
        part = lambda mark, x: on.let(x, lambda q: on.case((on.same(q, on.lit("")), q), other=on.concat(on.lit(mark), q)))
        return on.concat(on.case((on.same(scheme, on.lit("https")), on.lit("http")), other=scheme), on.lit("://"), on.replace(bare, r"^www\.", ""), trail, part("?", query), part("#", get(5)))

    return on.let(on.lower(url), body)
