"""Host words that the URL filter blocks where no rule fits (fixed values)."""

BLOCKED_WORDS = [
    "adult", "ads", "adserver", "advert", "adverts", "banner", "bet", "bets", "betting", "bingo", "casino", "casinos",
    "cam", "cams", "clickbait", "crack", "cracks", "erotic", "escort", "escorts", "fetish", "gambling", "hentai",
    "jackpot", "keygen", "linkfarm", "lottery", "malware", "milf", "nude", "nudes", "payday", "pharma", "phishing",
    "pills", "poker", "porn", "porno", "replica", "roulette", "sex", "sexy", "slots", "spam", "spyware", "torrent",
    "torrents", "tracker", "tracking", "viagra", "warez", "webcam", "webcams", "xxx",
]
