"""Invented prose in four languages."""

WORDS = {
    "en": "the of and to in is that it was for on with as by at from this be are have not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont aux avec son cette ou être mais comme nous leur sa ont même ces fait été aussi elle deux tout après bien peut sous encore entre toute faire ses sans autres dont temps très lui avant moins car ainsi selon années était tous".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros".split(),
}


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang], n))


DOC = "doc_id long, text string, lang string, source string, n_chars long"
