"""Dictionaries of refusals and languages, as tables by language."""

from __future__ import annotations

# Patterns by which a writer in the first person declines.
UNABLE = {
    "en": [
        r"\bI(?:'m| am|’m)? (?:cannot|can['’]?t|can not|won['’]t|will not|am unable|unable|not able|do not feel able|must decline|have to decline|must refuse|regret|afraid)", r"\bI (?:do not|don['’]t) (?:feel able|think I can)",
        r"\b(?:not|isn['’]t|is not|nothing) (?:something )?(?:that )?I(?:['’]m| am)? (?:can|able|allowed|comfortable)", r"\bunable to (?:help|assist|comply|complete|process|provide|continue)", r"\bno can do\b", r"\bcan['’]?t help\b",
        r"\b(?:falls )?outside (?:of )?(?:my|what I)\b", r"\bviolat\w+ .{0,20}(?:guidelines|polic)", r"\bagainst (?:my|the|our) .{0,20}(?:guidelines|polic)", r"\bbeyond what I (?:can|may)\b", r"\bI(?:['’]d| would) rather not\b",
    ],
    "de": [r"\bkann ich .{0,40}nicht", r"\bich kann .{0,60}nicht", r"\bdarf ich .{0,40}nicht", r"\bich darf .{0,60}nicht", r"\bnicht in der lage\b", r"\bnicht möglich\b", r"\bmöchte ich .{0,40}nicht", r"\bleider nicht\b", r"\bich muss .{0,30}ablehnen"],
    "fr": [r"\bje ne (?:peux|suis|pourrai|saurais|dois)\b", r"\bil m['’]est impossible\b", r"\bimpossible d['’]", r"\bje (?:dois|préfère) (?:refuser|décliner)", r"\bpas en mesure\b", r"\bje regrette\b"],
    "es": [r"\bno (?:puedo|podré|podría)\b", r"\bno me es posible\b", r"\bme (?:resulta|es) imposible\b", r"\bno estoy en condiciones\b", r"\bdebo (?:rechazar|declinar)", r"\bno soy capaz\b", r"\blamento\b"],
    "it": [r"\bnon (?:posso|potrò|potrei|riesco|sono in grado)\b", r"\bmi è impossibile\b", r"\bnon mi è possibile\b", r"\bdevo (?:rifiutare|declinare)"],
    "pt": [r"\bnão (?:posso|poderei|consigo|me é possível|sou capaz|estou apt)\b", r"\b(?:é|seria)-me impossível\b", r"\btenho de recusar\b", r"\bpreciso recusar\b"],
    "nl": [r"\bkan ik .{0,40}niet\b", r"\bik kan .{0,60}niet\b", r"\bmag ik .{0,40}niet\b", r"\bniet in staat\b", r"\bik moet .{0,30}weigeren"],
    "pl": [r"\bnie (?:mogę|jestem w stanie|potrafię|mogłabym|mógłbym)\b", r"\bmuszę odmówić\b"],
    "sv": [r"\bjag kan (?:tyvärr )?inte\b", r"\bkan jag (?:tyvärr )?inte\b", r"\binte möjligt för mig\b"],
    "ru": [r"\bя не (?:могу|вправе|в состоянии|смогу)", r"\bне (?:могу|смогу) (?:помочь|выполнить|обработать|сократить)", r"\bвынужден[а]? отказать"],
    "zh": [r"我(?:无法|不能|没办法|不便)", r"(?:无法|不能)(?:完成|处理|帮助|协助|提供)", r"恕难"],
    "ja": [r"できません", r"致しかねます", r"いたしかねます", r"お(?:応え|答え)できません", r"お断り"],
    "hi": [r"नहीं कर (?:सकता|सकती|पाऊँग)", r"असमर्थ"],
    "ar": [r"لا (?:أستطيع|يمكنني|أقدر)", r"لن أتمكن", r"أعتذر عن"],
    "th": [r"ไม่สามารถ", r"ไม่อาจ"],
    "tr": [r"(?:edemem|yapamam|veremem|edemiyorum|yapamıyorum)\b", r"mümkün değil"],
}
# Excuses, and what only a model says of itself.
SORRY = {
    "en": [r"\bsorry\b", r"\bI apologi[sz]e\b", r"\bI(?:['’]m| am) afraid\b", r"\bunfortunately\b", r"\bI regret\b"],
    "de": [r"\bes tut mir leid\b", r"\bich bedau?re\b", r"\bleider\b", r"\bentschuldig"],
    "fr": [r"\bdésolée?\b", r"\bje regrette\b", r"\bmalheureusement\b"],
    "es": [r"\blo siento\b", r"\blamento\b", r"\blamentablemente\b", r"\bdisculp"],
    "it": [r"\bmi (?:dispiace|spiace)\b", r"\bpurtroppo\b", r"\bsono spiacente\b"],
    "pt": [r"\b(?:lamento|desculp\w+|sinto muito)\b", r"\binfelizmente\b"],
    "nl": [r"\bhet spijt me\b", r"\bhelaas\b", r"\bsorry\b"],
    "pl": [r"\bprzepraszam\b", r"\bniestety\b", r"\bprzykro mi\b"],
    "sv": [r"\btyvärr\b", r"\bbeklagar\b", r"\bledsen\b"],
    "ru": [r"\bизвините\b", r"\bк сожалению\b", r"\bпростите\b"],
    "zh": [r"抱歉", r"对不起", r"很遗憾"],
    "ja": [r"申し訳", r"恐れ入りますが", r"残念ながら"],
    "hi": [r"क्षमा करें", r"खेद है", r"माफ़"],
    "ar": [r"عذرا", r"آسف", r"للأسف", r"أعتذر"],
    "th": [r"ขออภัย", r"ขอโทษ", r"เสียใจ"],
    "tr": [r"\büzgünüm\b", r"\bmaalesef\b"],
}
MODEL = [
    r"\bas an? (?:ai|artificial|language model|large language|assistant)\b", r"\bals (?:ki|sprachmodell|sprach-ki)\b", r"\ben tant que modèle\b", r"\bcomo modelo de (?:lengua|linguagem)\w*", r"\bcome modello linguistico\b", r"\bals taalmodel\b",
    r"\bjako model językowy\b", r"языковая модель", r"作为.{0,6}(?:语言)?模型", r"言語モデル", r"भाषा मॉडल", r"نموذج لغوي", r"โมเดลภาษา",
]
# Words for the task that is declined, as a writer about anything may use them, ...
TASK = {
    "en": [r"\b(?:request\w*|passage|text|bracket|material|content|task|guidelines|rewrit\w+|abridg\w+|summar\w+|complete this|this|that|copyrighted|help|assist\w*|do)\b"],
    "de": [r"\b(?:texte?s?|abschnitt\w*|anfrage\w*|kürz\w+|zusammenfass\w+|helfen|aufgabe|wiedergeben|bearbeiten|dabei)\b"],
    "fr": [r"\b(?:passage|demande|abréger|résumer|extrait|texte|aider|traiter|tâche|requête)\b"],
    "es": [r"\b(?:fragmento|texto|solicitud|resumir|ayudar\w*|petición|pasaje|tarea|procesar)\b"],
    "it": [r"\b(?:testo|brano|richiesta|riassum\w+|aiutar\w*|passaggio|compito|abbreviar\w+)\b"],
    "pt": [r"\b(?:texto|trecho|pedido|resumir|ajud\w+|passagem|tarefa|solicitação|abreviar)\b"],
    "nl": [r"\b(?:tekst|passage|verzoek|samenvat\w*|helpen|taak|inkorten)\b"],
    "pl": [r"\b(?:tekst\w*|fragment\w*|prośb\w+|streści\w*|pomóc|zadani\w+|skrócić)\b"],
    "sv": [r"\b(?:text\w*|avsnitt\w*|begäran|sammanfatta|hjälpa|uppgift\w*|förkorta)\b"],
    "ru": [r"просьб|отрывок|отрывк|текст|сократить|помочь|запрос|задани|пересказ"],
    "zh": [r"文字|内容|请求|这段|段落|缩写|文章|任务|概括|要求"],
    "ja": [r"要約|要望|依頼|文章|本文|短縮|内容"],
    "hi": [r"अंश|पाठ|अनुरोध|सहायता|संक्षे|मदद"],
    "ar": [r"المقطع|النص|الطلب|تلخيص|المساعدة|طلبك"],
    "th": [r"ข้อความ|คำขอ|ย่อ|ช่วย|เนื้อหา"],
    "tr": [r"\b(?:metin|metni|isteğ\w+|özet\w+|yardım\w*)\b"],
}
# ... and as only the writer of a result says them of the task itself.
OWN_TASK = [
    r"\b(?:request|rewrit\w+|abridg\w+|summari\w+|guidelines|copyrighted|this (?:passage|text|content|material|excerpt|task)|(?:the|your) (?:passage|text|excerpt|material) (?:provided|given|you))\b",
    r"anfrage|\bkürzen|zusammenfass|diese[nrsm]? (?:text|abschnitt|auszug)|votre demande|cette demande|abréger|résumer|\bcet? (?:texte|passage|extrait)|solicitud|petición|resumir|\beste (?:texto|fragmento)",
    r"richiesta|riassumere|questo (?:testo|brano)|este trecho|\bpedido\b|deze (?:tekst|passage)|verzoek|samenvatten|tego (?:tekstu|fragmentu)|streścić|denna text|sammanfatta",
    r"просьб|запрос|сократить|это[тго]+ (?:текст|отрыв)|请求|缩写|这段|要約|ご?依頼|अनुरोध|संक्षे|الطلب|تلخيص|คำขอ|ย่อ",
]

# Frequent words by language, for texts in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to in a an any ever is was that it for on as with by at from his her their but not had before after without this which who where because during between no were so if they he she we you been are have would could when while although into until",
    "de": "der die das und in den von zu mit dem des ein eine einer einen im am auf ist war nicht sich auch als an nach aus bei hinter unter zum zur wer wie während trotz noch ohne gegen hat haben wird sie es er wir aber oder wenn dass über vor zwischen durch werden wurde",
    "fr": "le la les de des du et en un une dans à au aux pour par sur est était qui que ne pas avec sans ce cette il elle après avant vers malgré pendant puis l d c qu s mais ou nous vous ils leur sont été plus entre sous chez comme",
    "es": "el la los las de del y en un una a al con por para que no se su es fue sin sobre entre hasta este esta como más pero lo ha había era antes después durante desde cuando también muy ya quién donde",
    "it": "il lo la gli le di del della e in un una che non si con per dal nel alla sono era come più anche dopo prima dei delle degli nella sul ma questo questa ha aveva fu loro quando ancora tra fra",
    "pt": "o a os as de do da e em um uma que não se com por para no na dos das ao foi mais como depois antes mas ou seu sua é são era pelo pela até também quando entre sobre já ele ela",
    "nl": "de het een van en in op te dat niet is was met voor aan door als bij naar om uit over maar zijn ook dan nog wel hij zij ze er deze dit werd worden hebben heeft had geen tot",
    "pl": "i w z na do że się nie jest był była było to jak po od dla przez przed ale oraz który która które za o już tylko co pod nad między jego jej ich są może",
    "ro": "și de la în cu pe nu este era sunt un o care pentru din că mai dar după fără prin spre lui ei lor acest această fost au a al ale se sau",
    "sv": "och i att det som en på är av för med den till inte om ett han hon de var från eller men hade har vid efter under över kan skulle utan mellan också",
    "da": "og i at det som en på er af for med den til ikke om et han hun de var fra eller men havde har ved efter under over kan skulle uden mellem også blev",
    "cs": "a v na se že je to s z do o k i ale jako po za by byl byla bylo jsou který která které pro od před při nebo jen už jeho její",
    "hu": "a az és hogy nem is egy meg volt van ez de ha csak már mint után előtt között vagy akkor még sem ki mi be fel el azt ezt",
    "fi": "ja on oli ei se että hän he joka mutta kun niin kuin myös ovat sen hänen tai jos vain ennen jälkeen sekä olla ollut tämä sitä",
    "tr": "ve bir bu da de için ile olarak olan gibi daha çok ne ama sonra önce kadar ise değil var yok o her en ya mi diye",
    "id": "yang dan di ke dari untuk dengan pada ini itu tidak adalah dalam oleh akan telah sudah juga atau karena sebagai mereka dia kami ada setelah sebelum",
}
