"""Label cleaning and remapping for the three flow-record families.

``unsw`` has a 0/1 or text ``label`` and an ``attack_cat``; ``cic`` names attacks in
``Label`` with ``BENIGN`` for normal traffic; ``nsl`` names 39 attacks and ``normal``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FAMILIES = ("unsw", "cic", "nsl")

# Attack name -> attack family of the nsl records.
ATTACK_FAMILIES = {
    "dos": "back land neptune pod smurf teardrop mailbomb apache2 processtable udpstorm",
    "probe": "ipsweep nmap portsweep satan mscan saint",
    "r2l": (
        "ftp_write guess_passwd imap multihop phf spy warezclient warezmaster sendmail "
        "named snmpgetattack snmpguess xlock xsnoop worm"
    ),
    "u2r": "buffer_overflow loadmodule perl rootkit httptunnel ps sqlattack xterm",
}

# Tokens read as the negative / positive class.
BENIGN_TOKENS = ["benign", "normal", "0"]
ATTACK_TOKENS = ["attack", "attacks", "malicious", "anomaly", "intrusion", "1"]
# Tokens the unsw 0/1 label accepts as an attack.
UNSW_ATTACK_TOKENS = ["1", "1.0", "attack", "malicious", "anomaly"]


def normalize(c: Column) -> Column:
    """Trim and delete every dot."""
    return F.replace(F.trim(c), F.lit("."), F.lit(""))


def binary_text(c: Column, family: str) -> Column:
    """Two-class text label: normal/attack (unsw, nsl) or BENIGN/ATTACK (cic).

    Works on the normalised label, so "1.0" reads as "10" and is not an attack.
    """
    n = normalize(c)
    if family == "unsw":
        return F.when(n.isin("1", "attack"), "attack").otherwise("normal")
    if family == "cic":
        return F.when(F.upper(n) == "BENIGN", "BENIGN").otherwise("ATTACK")
    if family == "nsl":
        return F.when(n == "normal", "normal").otherwise("attack")
    raise ValueError(f"unknown family: {family}")


def binary_flag(c: Column, family: str) -> Column:
    """Direct 0/1 label (1 = attack); a missing label reads as its own text, as in a CSV."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("nan")))
    if family == "unsw":
        hit = F.lower(text).isin(UNSW_ATTACK_TOKENS)
    elif family == "cic":
        hit = F.upper(text) != "BENIGN"
    elif family == "nsl":
        hit = F.lower(F.replace(text, F.lit("."), F.lit(""))) != "normal"
    else:
        raise ValueError(f"unknown family: {family}")
    return hit.cast("int")


def attack_family(c: Column, families: Mapping[str, str] | None = None) -> Column:
    """Attack name -> family; ``normal`` stays, unknown names become ``other``."""
    n = normalize(c)
    out = F.when(n == "normal", "normal")
    for family, names in (families or ATTACK_FAMILIES).items():
        out = out.when(n.isin(names.split()), family)
    return out.otherwise("other")


def collapse_multiclass(c: Column) -> Column:
    """Group cic attack names by ordered substring rules; unmatched names stay."""
    text = normalize(c)
    low = F.lower(text)
    any_of = lambda *words: F.rlike(low, F.lit("|".join(words)))
    return (
        F.when(F.upper(text) == "BENIGN", "BENIGN")
        .when(any_of("web attack", "brute force", "xss", "sql injection"), "WebAttack")
        .when(low.contains("ftp-patator"), "FTP-Patator")
        .when(low.contains("ssh-patator"), "SSH-Patator")
        .when(low.contains("ddos"), "DDoS")
        .when(low.contains("dos"), text)
        .when(low.contains("portscan"), "PortScan")
        .when(low.contains("bot"), "Bot")
        .when(low.contains("infiltration"), "Infiltration")
        .when(low.contains("heartbleed"), "Heartbleed")
        .otherwise(text)
    )


def present(c: Column) -> Column:
    """True where a multiclass label holds a usable name."""
    n = normalize(c)
    return n.isNotNull() & ~n.isin("", "nan", "NaN")


def encode_binary(c: Column, strict: bool = False) -> Column:
    """0/1 from the accepted tokens; anything else is null, or an error if strict."""
    token = F.lower(F.trim(c))
    bad = F.raise_error(F.concat(F.lit("unexpected binary label: "), F.coalesce(c, F.lit("null"))))
    coded = F.when(token.isin(BENIGN_TOKENS), 0).when(token.isin(ATTACK_TOKENS), 1)
    return (coded.otherwise(bad.cast("int")) if strict else coded).cast("int")


def names_attack(c: Column) -> Column:
    """Does a class name denote the positive class?"""
    name = F.lower(F.trim(c))
    return name.isin(ATTACK_TOKENS) | name.contains("attack")
