ODD_TEXTS = [
    "", "<|startoftext|> hi<|endoftext|>there", "it's I'll 'tis o'clock ''s x's'", "ΑΣ ΌΣΟΣ İstanbul ẞ", "a\x1cb\x85c　d",
    "日本語テキスト 한국어 ١٢٣", "👍🏽 é ́x" + "a" * 300 + " " + "#" * 200 + " \x00\x01 ﷺ", " \n\t ", "antidisestablishmentarianism " * 3,
]
