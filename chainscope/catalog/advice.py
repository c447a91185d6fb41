"""What a finding of each category means, how it is mended and when it is none.

Texts of our own, one set for each category: they explain findings to a reader
and take no part in any result.  Tags come from the rule itself.
"""

from __future__ import annotations

# category -> (description, fix, false positive)
ADVICE = {
    "A01:2021": ("Code reaches files, routes or records without checking that the caller may.",
                 "Check the caller's rights on the server and resolve user input against a list or a base folder.",
                 "The value is a constant, or an earlier layer has checked it."),
    "A02:2021": ("Data is hashed, encrypted, sent or compared in a way that can be broken or observed.",
                 "Use current algorithms with random keys and salts, TLS, and comparisons in constant time.",
                 "The value protects nothing, such as a cache key or a checksum."),
    "A03:2021": ("User input becomes part of code, a query, a command or markup.",
                 "Pass input as parameters, or encode it for where it goes; do not build code from text.",
                 "The text is a constant or was validated against a list."),
    "A04:2021": ("The design lacks a limit or check that abuse would meet.",
                 "Add limits, validation and safe defaults where the input enters.",
                 "The limit is enforced elsewhere, such as in a gateway."),
    "A05:2021": ("A setting leaves a service more open than it needs to be.",
                 "Set the strict value and allow exceptions one by one.",
                 "The setting is for development only and never deployed."),
    "A06:2021": ("A component is outdated, unpinned or fetched from a place that can change.",
                 "Pin a maintained version and its integrity hash.",
                 "The component is not part of what is shipped."),
    "A07:2021": ("Identity, sessions or passwords are handled in a way that can be guessed, stolen or skipped.",
                 "Use proven session and token libraries, short lifetimes and strong secrets from the environment.",
                 "The value is a placeholder or belongs to a test account."),
    "A08:2021": ("Code or data is taken over without a check of where it comes from.",
                 "Verify signatures or hashes, and parse data with a schema instead of evaluating it.",
                 "The source is part of the same build."),
    "A09:2021": ("An error or security event is hidden, or a log holds what it should not.",
                 "Log the event without secrets or raw input, and do not swallow errors.",
                 "The error is expected there and handled elsewhere."),
    "A10:2021": ("The server fetches an address that a caller can choose.",
                 "Allow known hosts only and refuse private address ranges.",
                 "The address is fixed by configuration."),
    "EXTRA": ("A pattern that often goes with weaknesses in code of this kind.",
              "Prefer the typed, checked or encoded form of the same call.",
              "The use is deliberate and its input is known."),
}
