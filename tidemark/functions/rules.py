"""L-04: masking rules of published log sets, as (pattern, replacement) in the order in which they apply."""

from __future__ import annotations

# Patterns and replacements have to be these, in this order, for templates to be those of the published results.
HDFS = [
    (r"/?(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?", "<IP>"),
    (r"blk_(|-)[0-9]+", "<blk_>"),
]
BGL_MESSAGES = [
    (r"(ddr: activating redundant bit steering).*$", r"${1} <MASK>"),
    (r"(core files for program)\s+.*$", r"${1} <MASK>"),
    (r"(critical input interrupt).*warning for .* wire.*$", r"${1} <MASK>"),
    (r"(link training failed:)\s*wanted:.*$", r"${1} <MASK>"),
    (r"(bad message header:)\s*.*$", r"${1} <MASK>"),
    (r"^(\S+) .*Registers?:.*$", r"${1} <MASK>"),
    (r"^(\S+) [a-z]\w*=.*$", r"${1} <MASK>"),
    (r"^(\S+) .*\.{3,}.*$", r"${1} <MASK>"),
    (r"(status=M)\s+.*$", r"${1} <MASK>"),
    (r"^(FAILURE) Link .*$", r"${1} <MASK>"),
    (r"^(\S+) While (?:reading FanModule|setting fan speed) caught.*$", r"${1} <MASK>"),
    (r"^(\S+) Hardware monitor caught java\.net\.SocketException.*$", r"${1} <MASK>"),
    (r"(INFO) .*ddr error\(s\) detected and corrected.*$", r"${1} <MASK> ddr error(s) detected and corrected <MASK>"),
    (r"^ERROR\b.*$", "ERROR <MASK>"),
    (r"^INFO\s*$", "INFO <MASK>"),
    (r"ddr:\s+Suppressing.*$", "<MASK>"),
    (r"\d+\s+microseconds spent in the rbs signal.*$", "<MASK>"),
    (r"\d+\s+total interrupts.*$", "<MASK>"),
    (r"CE\s+sym\b.*$", "<MASK>"),
    (r"\(dcr\s+.*$", "<MASK>"),
    (r"Kernel detected.*$", "<MASK>"),
    (r"MACHINE CHECK DCR\s+.*$", "<MASK>"),
    (r"ciod:\s+Received signal.*$", "<MASK>"),
    (r"L1 DCACHE summary averages.*$", "<MASK>"),
    (r"ciod: generated .*core files for program.*$", "<MASK>"),
    (r"data cache .*parity error detected.*$", "<MASK>"),
    (r"Controlling BG.*rows.*$", "<MASK>"),
    (r"\S+ has been started:.*$", "<MASK>"),
    (r"Node card VPD check: missing.*$", "<MASK>"),
    (r"EndServiceAction.*$", "<MASK>"),
    (r"ciod: Error loading .*$", "<MASK>"),
    (r"(Temperature Over Limit|PGOOD error latched|Power Deactivated).*$", "<MASK>"),
    (r"number of corrected SRAM errors has exceeded.*$", "<MASK>"),
]
BGL_VALUES = [
    (r"\b\d{1,2}:[0-9a-fA-F]{8}\b", "<MASK>"),
    (r"\b0x[0-9a-fA-F]{1,16}\b", "<MASK>"),
    (r"\b[0-9a-fA-F]{8,}\b", "<MASK>"),
    (r"\b\d+\b", "<MASK>"),
    (r"/[^\s]+", "<PATH>"),
]
THUNDERBIRD_MESSAGES = [
    (r"^(kernel:) (?:<[0-9a-f]+>)?\{[^}]*\+\d+\}.*$", r"${1} <TRACE>"),
    (r"(page allocation failure).*$", r"${1} <MASK>"),
    (r"^(kernel:) Active:\d+ inactive:.*$", r"${1} <MEMSTAT>"),
    (r"^(kernel:) [A-Za-z_]+\(\d+\):.*$", r"${1} <MODULE> <MASK>"),
    (r"^(kernel:) [a-z_]+: .*$", r"${1} <SUBSYS> <MASK>"),
]
THUNDERBIRD_VALUES = [
    (r"/[^\s]+", "<PATH>"),
    (r"0x[0-9a-fA-F]+", "<ADDRESS>"),
    (r"\b\d+\.\d+\.\d+\.\d+\b", "<IP>"),
    (r"\b(?:[0-9A-Fa-f]{2}:){5,}[0-9A-Fa-f]{2}\b", "<MAC>"),
    (r"\b[0-9a-fA-F]{6,}\b", "<HEX>"),
    (r"\[\d+\]", "[<NUM>]"),
    (r"\*\d+", "<NUM>"),
    (r"\b\d+\b", "<NUM>"),
    (r"\[[A-Z]{2,}\w*\]", "[<ID>]"),
    (r"\b[a-zA-Z]+[0-9][a-zA-Z0-9]*\b", "<ALNUM>"),
    (r"\b[0-9]+[a-zA-Z][a-zA-Z0-9]*\b", "<ALNUM>"),
    (r"(<NUM> ){3,}<NUM>", "<NUMS> "),
]
RULES = {"hdfs": HDFS, "bgl": BGL_MESSAGES + BGL_VALUES, "thunderbird": THUNDERBIRD_MESSAGES + THUNDERBIRD_VALUES}
