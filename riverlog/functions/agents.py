"""User agents: browser, version, system, its version, device and kind, from ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first pattern that matches names the browser; its first group is the version.
BROWSERS = (
    (r"(?i)YandexBot/?([\d.]*)", "YandexBot"), (r"(?i)Googlebot/?([\d.]*)", "Googlebot"), (r"(?i)bingbot/?([\d.]*)", "Bingbot"),
    (r"(?i)DuckDuckBot/?([\d.]*)", "DuckDuckBot"), (r"(?i)Baiduspider/?([\d.]*)", "Baiduspider"), (r"(?i)AhrefsBot/?([\d.]*)", "AhrefsBot"),
    (r"(?i)SemrushBot/?([\d.]*)", "SemrushBot"), (r"(?i)facebookexternalhit(?:/([\d.]+))?", "Facebook"), (r"(?i)Twitterbot/?([\d.]*)", "Twitterbot"),
    (r"(?i)Slackbot(?:-LinkExpanding)?/?([\d.]*)", "Slackbot"), (r"(?i)LinkedInBot/?([\d.]*)", "LinkedInBot"), (r"(?i)(?:Bot|Spider|Crawler|Scrapy)()", "Other Bot"),
    (r"Edg(?:e|A|iOS)?/([\d.]+)", "Edge"), (r"OPR/([\d.]+)", "Opera"), (r"Opera[\s/]([\d.]+)", "Opera"), (r"Chrome/([\d.]+)", "Chrome"),
    (r"Chromium/([\d.]+)", "Chromium"), (r"Firefox/([\d.]+)", "Firefox"), (r"Trident/.*rv:([\d.]+)", "Internet Explorer"), (r"MSIE\s+([\d.]+)", "Internet Explorer"),
    (r"Version/([\d.]+).*Safari", "Safari"), (r"Safari/[\d.]+()", "Safari"), (r"curl/([\d.]+)", "curl"), (r"Wget/([\d.]+)", "Wget"),
    (r"python-requests/([\d.]+)", "python-requests"), (r"python-urllib/?([\d.]*)", "python-urllib"), (r"Go-http-client/([\d.]+)", "Go HTTP Client"),
    (r"Java/([\d.]+)", "Java"), (r"Apache-HttpClient/([\d.]+)", "Java HttpClient"), (r"libwww-perl/([\d.]+)", "libwww-perl"), (r"LWP::UserAgent()", "libwww-perl"),
    (r"(?i)(?:node|axios|undici)()", "Node.js"),
)
# Systems; None takes the version from the group, with dots for underscores.
SYSTEMS = (
    (r"Windows NT 10\.0", "Windows", "10/11"), (r"Windows NT 6\.3", "Windows", "8.1"), (r"Windows NT 6\.2", "Windows", "8"), (r"Windows NT 6\.1", "Windows", "7"),
    (r"Windows NT 6\.0", "Windows", "Vista"), (r"Windows NT 5\.[12]", "Windows", "XP/2003"), (r"Windows Phone", "Windows Phone", ""), (r"Windows 98", "Windows", "98"),
    (r"Windows", "Windows", ""), (r"iPhone", "iOS", "iPhone"), (r"iPad", "iOS", "iPad"), (r"iPod", "iOS", "iPod"), (r"Android[\s/](\d+(?:\.\d+)*)", "Android", None),
    (r"Android", "Android", ""), (r"Mac OS X[ _]([\d_]+)", "macOS", None), (r"Macintosh|Mac_PowerPC", "macOS", ""), (r"Ubuntu", "Linux", "Ubuntu"),
    (r"Debian", "Linux", "Debian"), (r"Fedora", "Linux", "Fedora"), (r"CentOS", "Linux", "CentOS"), (r"FreeBSD", "FreeBSD", ""), (r"OpenBSD", "OpenBSD", ""),
    (r"(?i)Linux", "Linux", ""), (r"(?i)curl|Wget|python|Go-http|Java|libwww|Node\.js", "Other", "CLI/library"),
)
BOTS = ("YandexBot", "Googlebot", "Bingbot", "DuckDuckBot", "Baiduspider", "AhrefsBot", "SemrushBot", "Facebook", "Twitterbot", "Slackbot", "LinkedInBot", "Other Bot")
# What tells tablets and telephones.
TABLET, PHONE = "iPad|iPod", "iPhone|Android(?!.*(?:Tablet|SM-T))|Mobile Safari"
TOOLS = ("curl", "Wget", "python-requests", "python-urllib", "Go HTTP Client", "Java", "Java HttpClient", "libwww-perl", "Node.js")


def classify(ua: Column) -> Column:
    """struct<browser, version, os, os_version, device, kind> of a user agent."""
    ua = F.coalesce(ua, F.lit(""))
    none = ua.isin("", "-")
    browser, version = F.when(none, "Unknown"), F.when(none, "")
    for pattern, name in BROWSERS:
        browser = browser.when(ua.rlike(pattern), name)
        version = version.when(ua.rlike(pattern), F.regexp_extract(ua, pattern, 1))
    system, system_version = F.when(none, "Unknown"), F.when(none, "")
    for pattern, name, fixed in SYSTEMS:
        system = system.when(ua.rlike(pattern), name)
        system_version = system_version.when(ua.rlike(pattern), F.replace(F.regexp_extract(ua, pattern, 1), F.lit("_"), F.lit(".")) if fixed is None else F.lit(fixed))
    first = F.struct(browser.otherwise("Unknown").alias("browser"), version.otherwise("").alias("version"), system.otherwise("Unknown").alias("os"), system_version.otherwise("").alias("os_version"))

    def whole(x: Column) -> Column:
        bot, tool = x["browser"].isin(*BOTS), x["browser"].isin(*TOOLS)
        mobile = ua.rlike(PHONE)
        device = F.when(none, "Other").when(bot, "Bot").when(tool, "Other").when(ua.rlike(TABLET), "Tablet").when(mobile, "Mobile").when(x["os"] == "Android", "Tablet").otherwise("Desktop")
        kind = F.when(bot, "bot").when(tool, "tool").otherwise("browser")
        return F.struct(x["browser"].alias("browser"), x["version"].alias("version"), x["os"].alias("os"), x["os_version"].alias("os_version"), device.alias("device"), kind.alias("kind"))

    return F.transform(F.array(first), whole)[0]
