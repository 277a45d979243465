"""Rule-based labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def grade(pct: Column) -> Column:
    """Letter of a percentage: A from 85, B from 70, C from 50, D from 30, else F."""
    return F.when(pct >= 85, "A").when(pct >= 70, "B").when(pct >= 50, "C").when(pct >= 30, "D").otherwise("F")


def coverage_status(n: Column, live: int, partial: int, previous: Column) -> Column:
    """live, partial, or what was there before; a blocked source stays blocked."""
    return F.when(previous == "blocked", previous).when(n >= live, "live").when(n >= partial, "partial").otherwise(F.coalesce(previous, F.lit("none")))


def review_flag(source: Column, confidence: Column, trusted: Sequence[str] = ()) -> Column:
    """promote from 0.95 (0.85 for trusted sources), flag from 0.70, else reject."""
    need = F.when(source.isin(*trusted), 0.85).otherwise(0.95) if trusted else F.lit(0.95)
    return F.when(confidence >= need, "promote").when(confidence >= 0.70, "flag").otherwise("reject")


def first_label(candidates: Sequence[Column], patterns: Mapping[str, str]) -> Column:
    """Label of the first pattern, in order, that the first matching candidate contains, whatever its case."""
    return F.coalesce(*(F.coalesce(*(F.when(F.contains(F.lower(c), F.lit(p.lower())), v) for p, v in patterns.items())) for c in candidates))


def site_class(label: Column, url: Column, party_hosts: Sequence[str]) -> Column:
    """shared, party_managed or personal."""
    return F.when(F.coalesce(label, F.lit("")) == "shared_official", "shared").when(F.lower(url).rlike("|".join(h.replace(".", r"\.") for h in party_hosts)), "party_managed").otherwise("personal")


def hosting_tier(country: Column, provider: Column, domestic_provider: Column, cdn: Column, failed: Column, home: str = "CA", rival: str = "US") -> Column:
    """1 home country and provider, 2 home country, 3 behind a CDN, 4 the rival country, 5 elsewhere or a known provider, 6 unknown."""
    named = F.coalesce(provider, cdn)
    return (
        F.when(failed & country.isNull() & named.isNull(), 6)
        .when((country == home) & domestic_provider, 1)
        .when(country == home, 2)
        .when(cdn.isNotNull(), 3)
        .when(country == rival, 4)
        .when(country.isNotNull(), 5)
        .when(named.isNotNull(), 5)
        .otherwise(6)
    )


# Text of hosts, networks and headers, in order, and what it stands for.
CDNS = {
    "cloudflare": "Cloudflare", "cloudfront": "AWS CloudFront", "akamai": "Akamai", "fastly": "Fastly", "vercel": "Vercel", "netlify": "Netlify",
    "azureedge": "Azure CDN", "azurefd": "Azure Front Door", "github.io": "GitHub Pages", "bunnycdn": "BunnyCDN", "bunny.net": "BunnyCDN",
    "stackpath": "StackPath", "incapsula": "Imperva", "imperva": "Imperva", "sucuri": "Sucuri", "keycdn": "KeyCDN", "cachefly": "CacheFly",
}
PROVIDERS = {
    "amazon": "Amazon Web Services", "aws": "Amazon Web Services", "googlecloud": "Google Cloud", "google": "Google", "microsoft": "Microsoft Azure", "azure": "Microsoft Azure",
    "digitalocean": "DigitalOcean", "linode": "Linode", "vultr": "Vultr", "hetzner": "Hetzner", "ovh": "OVHcloud", "godaddy": "GoDaddy", "squarespace": "Squarespace",
    "wordpress": "WordPress.com (Automattic)", "wpengine": "WP Engine", "wix": "Wix", "shopify": "Shopify", "nationbuilder": "NationBuilder", "heroku": "Heroku",
    "render": "Render", "fly.io": "Fly.io", "hostpapa": "HostPapa", "iweb": "iWeb", "cogeco": "Cogeco Peer 1",
}
SYSTEMS = {
    "wordpress": "WordPress", "drupal": "Drupal", "joomla": "Joomla", "ghost": "Ghost", "shopify": "Shopify", "wix": "Wix", "squarespace": "Squarespace",
    "nationbuilder": "NationBuilder", "craft": "Craft CMS",
}
DOMESTIC_NAMES = (
    "ovh hosting", "shared services canada", "canadian web hosting", "hostpapa", "iweb", "netfirms", "website.ca", "cira", "bell canada", "rogers",
    "telus", "videotron", "cogeco", "ehost canada", "shopify", "peer1", "evolutionhost",
)
DOMESTIC_NETWORKS = (13768, 32613, 7992, 812, 577, 852, 19531, 26782, 395152, 46562, 6724, 16509)


def first_label_in(candidates: Column, patterns: Mapping[str, str]) -> Column:
    """As first_label(), over an array of candidates; null ones are passed over."""
    label = lambda c: F.coalesce(*(F.when(F.contains(F.lower(c), F.lit(p)), v) for p, v in patterns.items()))
    return F.try_element_at(F.filter(F.transform(candidates, label), lambda x: x.isNotNull()), F.lit(1))


def domestic(org: Column, network: Column) -> Column:
    """Whether a network is a provider of the home country, by its owner's name or its number (AS123)."""
    number = F.regexp_extract(network, r"(?i)^AS?(\d+)", 1).try_cast("long")
    named = F.coalesce(F.lower(org).rlike("|".join(n.replace(".", r"\.") for n in DOMESTIC_NAMES)), F.lit(False))
    return named | F.coalesce(number.isin(*DOMESTIC_NETWORKS), F.lit(False))


def hosting(country: Column, org: Column, network: Column, cnames: Column, server: Column, powered_by: Column, nameservers: Column, failed: Column) -> Column:
    """struct<tier, provider, country, cdn, cms> of a site from what a scan saw; a CDN stands in for an unknown provider.

    cnames, nameservers: arrays, null being none.  A scan that failed and shows nothing has tier 6 and no provider.
    """
    none = F.array().cast("array<string>")
    chain, servers = F.coalesce(cnames, none), F.coalesce(nameservers, none)
    cdn = first_label_in(F.concat(chain, F.array(org), servers), CDNS)
    provider = F.coalesce(first_label_in(F.concat(F.array(org), chain, F.array(server)), PROVIDERS), cdn)
    cms = first_label_in(F.concat(F.array(server, powered_by), chain), SYSTEMS)
    tier = hosting_tier(country, provider, domestic(org, network), cdn, failed)
    return F.struct(tier.alias("tier"), provider.alias("provider"), country.alias("country"), cdn.alias("cdn"), cms.alias("cms"))
