"""Required literals of the rule patterns, used as exact prefilters.

Each entry lists literals of which at least one occurs in every text a pattern can match
(read off the pattern: a mandatory word, or every branch of a mandatory alternation).
The patterns run on lower-case views, so a plain substring test on the same view is an
exact and far cheaper first check; the regex only runs when it passes.
"""

from __future__ import annotations

from textguard.functions import lexicons as L

_JB = L.JAILBREAK_PATTERNS
PROMPT_JAILBREAK_REQUIRES = {
    _JB[0]: ["ignore"], _JB[1]: ["ignore"], _JB[2]: ["forget"], _JB[3]: ["act"], _JB[4]: ["act"],
    _JB[5]: ["pretend"], _JB[6]: ["roleplay"], _JB[7]: ["now"], _JB[8]: ["system"], _JB[9]: ["developer"],
    _JB[10]: ["admin"], _JB[11]: ["sudo"], _JB[12]: ["jailbreak"], _JB[13]: ["injection"],
    _JB[14]: ["safety"], _JB[15]: ["safety"], _JB[16]: ["safety"],
}

_OJ = L.OUTPUT_JAILBREAK_PATTERNS
OUTPUT_JAILBREAK_REQUIRES = {
    _OJ[0]: ["ignore"], _OJ[1]: ["mode"], _OJ[2]: ["bypass"], _OJ[3]: ["act"], _OJ[4]: ["anything"],
    _OJ[5]: ["safety"], _OJ[6]: ["free"], _OJ[7]: ["ignore"], _OJ[8]: ["mode"], _OJ[9]: ["jailbreak"],
    _OJ[10]: ["ignore"],
}

_G, _R, _F = (pats for _, pats in L.BIAS_PATTERNS)
BIAS_REQUIRES = {
    _G[0]: ["all"], _G[1]: ["behavior", "trait"], _G[2]: ["men"], _G[3]: ["should", "must", "can't"],
    _R[0]: ["all"], _R[1]: ["typical", "all"], _R[2]: ["race", "ethnicity"],
    _F[0]: ["all"], _F[1]: ["typical", "all"], _F[2]: ["religion", "faith"],
}
