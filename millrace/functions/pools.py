"""Word pools of the generators. Long ones come from syllable rules, short ones are listed."""

from __future__ import annotations

from itertools import product


def _joined(fronts: str, backs: str) -> list[str]:
    return [(a + b).capitalize() for a, b in product(fronts.split(), backs.split())]


FIRST_NAMES = _joined("al be ca da el fi ga ha il jo ka le ma ni ro", "na ra lia son vin mo ria bert dan sa lyn to ney ric mel")
LAST_NAMES = _joined("ash black brook car dun ell far grant hol kings lan marsh nor pem stan", "ton ford ley man well wood field worth by son bury den ham ster ridge")
CITIES = _joined("aber bel cor dal east fair glen high iron king lake mill new", "burg dale field ford haven mouth port side ton view wick bridge")
COUNTRIES = _joined("al bor car dan est fel gal hol ist", "avia onia land mark era istan ica")
#: Codes of ISO 3166-1.
COUNTRY_CODES = (
    "AD AE AF AG AL AM AO AR AT AU AZ BA BB BD BE BF BG BH BI BJ BN BO BR BS BT BW BY BZ CA CD CF CG CH CI CL CM CN CO CR CU CV CY CZ "
    "DE DJ DK DM DO DZ EC EE EG ER ES ET FI FJ FM FR GA GB GD GE GH GM GN GQ GR GT GW GY HN HR HT HU ID IE IL IN IQ IR IS IT JM JO JP "
    "KE KG KH KI KM KN KP KR KW KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MG MH MK ML MM MN MR MT MU MV MW MX MY MZ NA NE NG NI "
    "NL NO NP NR NZ OM PA PE PG PH PK PL PT PW PY QA RO RS RU RW SA SB SC SD SE SG SI SK SL SM SN SO SR SS ST SV SY SZ TD TG TH TJ TL "
    "TM TN TO TR TT TV TW TZ UA UG US UY UZ VA VC VE VN VU WS YE ZA ZM ZW"
).split()
WORDS = [a + b for a, b in product("lo ip do si am co ad el se tem".split(), "rem sum lor met tur pis cing".split())]
STREETS = _joined("oak elm maple cedar birch", "hill lake park river spring wood field stone mill grove")
STREET_KINDS = ["Street", "Avenue", "Road", "Lane", "Drive", "Court", "Place", "Way", "Terrace", "Square", "Row"]
COMPANY_BASES = _joined("nova delta omni terra vertex", "tech soft works line core data grid")
COMPANY_KINDS = ["Inc", "Ltd", "LLC", "Group", "Labs", "Partners", "Systems", "Holdings"]
DOMAINS = ["example.com", "example.org", "example.net", "mail.example.com", "post.example.org"]
TLDS = ["com", "org", "net", "io", "dev", "app"]
PATHS = ["home", "about", "docs", "blog", "shop", "news", "help", "team"]
#: Codes of ISO 4217.
CURRENCIES = "USD EUR GBP JPY CHF CAD AUD NZD SEK NOK DKK ISK PLN CZK HUF RON BGN TRY ILS AED SAR EGP ZAR NGN KES INR CNY HKD TWD KRW SGD THB IDR MXN BRL ARS".split()
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHANUMERIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + LETTERS + "0123456789"
BCRYPT = "./" + ALPHANUMERIC
