"""The small labelled table of the personal-data field: sentences of everyday letters, forms and notices.

A span is written {kind:slot}; <slot> is filled but carries no label. Slots are filled from numbering plans, address
habits and name lists of several countries, half of the names with invented words, so that the field learns shapes and
neighbours rather than words.
"""

from __future__ import annotations

import random

import regex

KINDS = {"e": "email", "t": "phone", "i": "idnum", "a": "address", "p": "person"}

# Frequent given names of several languages, in Latin letters.
GIVEN = (
    "Ada Agnes Ahmed Aisha Akira Alan Albert Alice Amara Amelia Ana Anders Andrea Anita Anna Anselm Antonio Beata Beatriz Björn Bruno Camille Carl Carlos Caspar Chiara Chloe Clara Daniel "
    "Dario David Diego Edith Elena Elif Elin Elodie Emil Emma Erik Esther Eva Fatima Felix Francesca Frank George Giulia Grace Gregor Hanna Hans Harold Helen Helene Henrik Hugo Ian Ida Ilse Ines "
    "Ingrid Irene Isabel Ivan Ivo Jack James Jane Jean Jelena Jens Joana João John Jonas José Joris Juan Julia Jürgen Kamal Karin Karl Katarina Kenji Klaus Laila Lars Laura Leo Lena Linda Louise "
    "Luca Lucia Luis Magda Mara Marco Margaret Maria Marie Marit Mark Marta Martin Mary Matteo Michael Mira Mohamed Monika Nadia Nathan Nina Noor Nora Odile Olga Oliver Omar Oskar Otto Pablo "
    "Paloma Paul Paula Pedro Peter Petra Pierre Priya Quentin Ramon Ravi Rebecca Renske Richard Robert Rosa Rufus Ruth Sabine Samuel Sara Silvan Simon Sofia Stefan Susan Tamsin Theo Thomas Tobias "
    "Tom Ulla Ursula Vera Victor Walter William Yuki Yusuf Zoë"
).split()
# Frequent family names of several languages, in Latin letters.
FAMILY = (
    "Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker White Green Hall Wood Harris Martin Clarke Reed Cooper Ward Turner Hill Moore Clark Baker Carter "
    "Bennett Fielding Manning Hastings Cunningham Keating Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Dubois Moreau Laurent Simon Michel "
    "Lefebvre Leroy Roux Fournier Girard Bonnet García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Ruiz Navarro Torres Rossi Bianchi Ferrari Russo Romano Ricci Conti Costa "
    "Silva Santos Pereira Oliveira Novak Kowalski Nowak Horvat Larsen Hansen Jensen Berg Lindqvist Nilsson Eriksson Dijkstra Bakker Visser Raman Patel Sharma Gupta Khan Hussain Okafor Mensah Diallo "
    "Tanaka Sato Suzuki Yılmaz Demir Papadopoulos Popescu Nagy"
).split()
INITIALS = "ABCDEFGHIJKLMNOPRSTUVW"
SYLLABLES = "ba ke li mor tan se vi dul gre pra no win sto fa ru he qua mel dor ash ven ost bri lan kes gal umb rost tar vel lind thar sol".split()
ENDINGS = ["", "", "", "n", "r", "l", "s", "man", "berg", "ton", "well", "son", "etti", "ova", "eaux", "wick", "ström", "ano", "ez", "ski", "lund", "by", "gast", "quist", "bury", "mond"]
MAIL_WORDS = "office info sales desk admin contact hello books press orders team help".split()
HOSTS = (
    "gmail.com outlook.com yahoo.co.uk corp.co.in uni-halle.de mail.ru free.fr web.de wanadoo.fr libero.it ono.es city.gov.uk example.com example.org acme-tools.com northern-rail.co.uk "
    "post.test data.io company.invalid shop.example mail.example.net clinic.example"
).split()
EN_STREET = "Street Road Lane Avenue Drive Close Court Place Square Terrace Row Way Crescent Gardens Hill Yard Grove Mews".split()
EN_ROADS = "High|Park|Station|Church|Mill|Green|Kings|North|Victoria|Chapel|Old Bridge|Upper Well|Orchard|Cooper's|St. John's|Queen's|Lower Market|Elm".split("|")
RU_GIVEN = "Иван Пётр Анна Мария Елена Сергей Дмитрий Ольга Николай Татьяна Михаил Наталья Андрей Светлана Павел Ирина Глеб Нина Вера Тихон".split()
RU_FAMILY = "Иванов Петров Сидорова Кузнецова Смирнов Попова Васильев Соколова Михайлов Новикова Фёдоров Морозова Волков Лебедева Егоров Козлова Марковин Вельская Дроздов Орловский Бельтанов Драгунин".split()
RU_ROADS = "ул. Садовая|пр. Мира|пер. Школьный|наб. Речная|ул. Новая|бульвар Победы|ул. Лесная|пр-т Ленина|пер. Тихий|наб. Старой Гавани".split("|")
# Frequent and older Chinese family names.
ZH_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文闻卓狄宓"
ZH_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰涛明超秀霞平刚桂英华文建国玉兰志远晓雨子涵思雅浩然书白念初若溪临川知伯庭砚秋宇轩"
ZH_ROADS = "人民路 中山街 解放路 学院巷 建设街 和平里 新华路 长江路 文化街 东门巷 桥头路 花园街 旧城巷 水井街 老水坊路 南城门街 大石桥巷 白马寺路".split()
JA_FAMILY = "佐藤 鈴木 高橋 田中 渡辺 伊藤 山本 中村 小林 加藤 吉田 山田 佐々木 松本 井上 木村 林 清水 斎藤 阿部 大島田 霧原 藤森 苑田 鳴海川 柚木 榛名 宮沢".split()
JA_GIVEN = "太郎 花子 健 誠 翔太 美咲 陽子 直樹 由美 大輔 律 澄江 蒼太 千夏 朔 澪".split()
JA_ROADS = "本町 桜台 中央 旭町 緑が丘 港町 若葉通り 水車通り 坂下 栄町 古町 見晴坂".split()
DE_ROADS = "Bahnhofstraße|Hauptstraße|Gartenweg|Lindenallee|Am Markt|Schulgasse|Ringstraße|Am Alten Hafen|Kirchplatz|Uferpromenade|Birkenweg|Seilergasse".split("|")
FR_ROADS = "rue de la Paix|avenue Victor-Hugo|boulevard du Port|place de l’Église|quai des Brumes|impasse du Moulin|chemin des Vignes|rue du Vieux-Pont|allée des Tilleuls|impasse des Potiers".split("|")
ES_ROADS = "Calle Mayor|Calle de la Luna|Plaza de España|Avda. de la Constitución|Paseo del Río|Camino Real|Callejón del Agua|Avda. de los Pinos|C/ San Juan|Ronda del Sur".split("|")
IT_ROADS = "Via Roma|Via Garibaldi|Piazza Dante|Corso Italia|Viale Europa|Via dei Mille".split("|")
LOW = (
    "the a and of to in on for with at from by as when then who which her his our their will has had was is not but so after before every under over about because please yesterday today soon "
    "comes came says said lives lived paid wrote sent brought saw met told asked plays knows door cake train letter roof money chair soup friend neighbour treasurer plumber tenant driver"
).split()
NOUNS = "garden kettle window market river ticket printer report meeting orchard letter bridge survey lamp catalogue council kitchen train exhibition ferry harbour merchant boundary festival museum valley story engine ledger chapter".split()
ADJ = "green narrow early broken quiet late careful annual hidden second wooden plain northern crowded bitter hand-made long-lost".split()
VERBS = "opened closed described measured repaired forgot praised sold rented painted counted moved defended replaced inherited".split()


def word(rng: random.Random) -> str:
    """An invented capitalised word."""
    return ("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 2))) + rng.choice(SYLLABLES)[:2] * rng.randint(0, 1) + rng.choice(ENDINGS)).capitalize()


def fill(rng: random.Random, key: str) -> str:  # noqa: C901, PLR0911, PLR0912
    """A value of a slot; in a form ``#`` stands for a digit, ``@`` for a capital."""
    pick = rng.choice

    def form(*forms: str) -> str:
        return "".join(str(rng.randint(0, 9)) if c == "#" else pick("ABCDKLMPTXYZ") if c == "@" else c for c in pick(forms))

    def given() -> str:
        return pick(GIVEN) if rng.random() < 0.5 else word(rng)

    def family() -> str:
        x = rng.random()
        name = pick(FAMILY) if x < 0.4 else word(rng)
        return f"{name}-{pick(FAMILY) if rng.random() < 0.5 else word(rng)}" if rng.random() < 0.2 else name

    n = rng.randint(1, 199)
    if key == "name":
        g, f, x = given(), family(), rng.random()
        if x < 0.12:
            return f"{pick(INITIALS)}. {pick(INITIALS)}. {f}"
        if x < 0.2:
            return f"{pick(INITIALS)}. {f}"
        if x < 0.32:
            return f"{f}, {g}"
        full = f"{g} {f}" if rng.random() < 0.93 else f"{g} {pick(INITIALS)}. {f}"
        return full.lower() if x < 0.42 else full.upper() if x < 0.46 else full
    if key == "name_c":
        return f"{family()}, {given()}"
    if key == "name_i":
        return f"{pick(INITIALS)}. {pick(INITIALS)}. {family()}"
    if key == "family":
        return family()
    if key in ("town", "place"):
        return word(rng) if rng.random() < 0.7 else f"{word(rng)} {pick(['upon Lea', 'Bay', 'Regis', 'Heath'])}"
    if key == "mail":
        g, f = (regex.sub(r"[^a-z-]", "", x.lower()) or "post" for x in (given(), family()))
        user = pick([f"{g}{pick('._-')}{f}{pick(['', '', str(rng.randint(1, 99))])}", f"{f}{rng.randint(1, 99)}", f"{g[0]}{f}", f"{pick(MAIL_WORDS)}", f"{g}+{pick(MAIL_WORDS)}", f"{g}", f"{g}_{f}{rng.randint(1, 99)}"])
        host, x = pick(HOSTS) if rng.random() < 0.5 else f"{pick(['', 'mail.', 'post.'])}{regex.sub('[^a-z]', '', word(rng).lower())}{pick(['', '-' + pick(SYLLABLES)])}.{pick(['com', 'org', 'net', 'de', 'fr', 'es', 'test', 'example', 'co.uk', 'invalid', 'example.org'])}", rng.random()
        if x < 0.12:
            return f"{user} {pick(['[at]', '(at)'])} {host.replace('.', ' [dot] ')}"
        if x < 0.18:
            return f"{user} (at) {host}"
        if x < 0.24:
            return f"{user} @ {host}"
        return f"{user}@{host}".upper() if x < 0.3 else f"{user}@{host}"
    if key == "phone":
        return form(
            "+1 ### ### ####", "###-###-####", "(###) ###-####", "###.###.####", "+44 ## #### ####", "+44 #### ######", "0## #### ####", "0#### ######", "0##########", "+91 ##### #####", "+49 ## #######",
            "+33 # ## ## ## ##", "+39 ## #### ####", "+61 4## ### ###", "+34 ### ### ###", "+353 # ### ####", "1-###-###-####", "+44 (0)## #### ####",
        )
    if key == "phone_us":
        return form("###.###.####", "###.###.####", "(###) ###-####", "###-###-####")
    if key == "phone_de":
        return form("0## #######", "+49 ## ########", "0##/#######", "(0##) ####-###", "01## #######", "0049 ## ######", "0049/##/######", "0049/##/########", "(0##) #####-###", "0### ##### ###", "0049 ## ########")
    if key == "phone_fr":
        return form("0# ## ## ## ##", "+33 # ## ## ## ##", "0#.##.##.##.##", "0# ## ## ## ##")
    if key == "phone_es":
        return form("6## ### ###", "9## ## ## ##", "+34 ### ## ## ##", "###-##-##-##", "9## ### ###")
    if key == "phone_ru":
        return form("+7 (###) ###-##-##", "8 (###) ###-##-##", "8 ### ### ## ##", "+7 ### ###-##-##")
    if key == "phone_ja":
        return form("0#-####-####", "090-####-####", "+81 # #### ####", "0##-###-####")
    if key == "phone_zh":
        return form("1##########", "010-########", "+86 ## #### ####", "0##-########", "+86 1## #### ####")
    if key == "id":
        return form("###-##-####", "### ## ####", "@########", "@@ ## ## ## @", "#########", "@@######@", "@@-####-####", "##@@#####")
    if key == "ssn":
        return form("###-##-####", "### ## ####")
    if key == "pass":
        return form("@########", "@@#######", "#########")
    if key == "card":
        return form("@@-####-####", "@@######", "@#######@")
    if key == "ni":
        return form("@@ ## ## ## @", "@@######@")
    if key == "id_fr":
        return form("1 ## ## ## ### ### ##", "2 ## ## ## ### ### ##", "##@@#####")
    if key == "id_de":
        return form("@##@@####", "## ### ### ###", "00 ### ### ###", "@########")
    if key == "id_es":
        return form("########@", "000#####@", "@-#######-@", "@-000####-@", "########-@")
    if key == "id_ru":
        return form("## ## ######", "00 ## ######", "#### ######")
    if key == "id_zh":
        return form("######19########", "######19######1X", "######20########", "00######19######1X", "00######19########")
    if key == "id_ja":
        return form("#### #### ####", "0000 #### ####", "############")
    if key == "addr":
        road = f"{pick(EN_ROADS) if rng.random() < 0.5 else word(rng)} {pick(EN_STREET)}"
        no, x = f"{n}{pick(['', '', '', 'a', 'b'])}", rng.random()
        road = road.upper() if rng.random() < 0.15 else road
        return f"Flat {rng.randint(1, 40)}, {no} {road}" if x < 0.18 else f"{no} {road}, {pick(['Apt.', 'Apt', 'Room', 'Unit'])} {rng.randint(1, 60)}" if x < 0.36 else f"{no} {road}"
    if key == "addr_de":
        road = pick(DE_ROADS) if rng.random() < 0.6 else word(rng) + pick(["weg", "straße", "gasse", "allee", "platz"])
        return f"{road} {n}{pick(['', '', 'a', f'-{n + 2}'])}"
    if key == "addr_fr":
        return f"{n}{pick(['', ' bis', ',', ' bis,', ' ter'])} {pick(FR_ROADS) if rng.random() < 0.7 else pick(['rue', 'quai', 'avenue', 'impasse']) + pick([' des ', ' du ', ' de ']) + word(rng)}"
    if key == "addr_es":
        road = pick(ES_ROADS) if rng.random() < 0.6 else pick(["Calle", "Plaza", "Avda.", "Paseo", "Callejón"]) + pick([" de ", " del ", " de la ", " de los "]) + word(rng)
        return f"{road}{pick([f', {n}', f' n.º {n}', f', {n}, {rng.randint(1, 6)}º {pick(INITIALS)}', f' {n}'])}"
    if key == "addr_it":
        return f"{pick(IT_ROADS)}{pick([', ', ' '])}{n}"
    if key == "addr_ru":
        return f"{pick(RU_ROADS)}, {pick(['д. ', 'д. ', 'дом '])}{n}{pick(['', f', кв. {rng.randint(1, 90)}'])}"
    if key == "addr_zh":
        return f"{pick(ZH_ROADS)}{n}号{pick(['', f'{rng.randint(1, 9)}室', f'{rng.randint(1, 9)}楼'])}"
    if key == "addr_ja":
        return f"{pick(JA_ROADS)}{rng.randint(1, 6)}丁目{rng.randint(1, 20)}{pick([f'-{rng.randint(1, 30)}', f'番{rng.randint(1, 30)}号', f'番地{rng.randint(1, 30)}'])}"
    if key == "name_ru":
        return f"{pick(RU_GIVEN)} {pick(RU_FAMILY)}"
    if key == "family_ru":
        return pick(RU_FAMILY)
    if key == "name_zh":
        return pick(ZH_FAMILY) + "".join(pick(ZH_GIVEN) for _ in range(rng.choice([1, 2, 2, 2])))
    if key == "name_ja":
        return f"{pick(JA_FAMILY)}{pick([' ', ' ', ''])}{pick(JA_GIVEN)}"
    if key == "w":
        return pick(LOW) if rng.random() < 0.7 else word(rng).lower()
    if key == "wd":
        return pick("der die das und bei nach mit von heute wohnt kam geht liegt sagt kennt bringt noch seit morgen für vom zieht ab dann hier dort auch".split())
    if key == "wf":
        return pick("le la les et chez avec pour demain habite vient est va dit connaît porte depuis ici alors aussi hier puis son ma notre au".split())
    if key == "ws":
        return pick("el la los y con para mañana vive viene es va dice conoce lleva desde aquí luego también ayer mi nuestro al a en".split())
    if key == "N":
        return pick("Paket Brief Markt Haus Garten Wagen Nachbar Schlüssel Morgen Stadt".split())
    if key == "code":
        return form("###.###.####", "###.###.###", "####-####", "###-####", "######/#", "#######", "##-####-###", "###.#.####")
    if key == "zip":
        return form("#####")
    if key == "n":
        return str(rng.randint(2, 980))
    if key == "year":
        return str(rng.randint(1640, 2020))
    if key == "dec":
        return f"{rng.randint(1, 90)}{pick('.,')}{rng.randint(1, 99)}"
    if key == "the":
        return f"the {pick(ADJ)} {pick(NOUNS)}" if rng.random() < 0.5 else f"the {pick(NOUNS)}"
    if key == "The":
        return fill(rng, "the").capitalize()
    if key == "did":
        return f"{pick(VERBS)} {fill(rng, 'the')}"
    if key == "Adj":
        return pick(ADJ).capitalize()
    if key == "Noun":
        return pick(NOUNS).capitalize()
    if key == "NOUN":
        return pick(NOUNS).upper()
    raise KeyError(key)


MARK = regex.compile(r"\{(\w):(\w+)\}|<(\w+)>")


def realised(rng: random.Random, line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """A labelled sentence with its slots filled, and its spans."""
    text, spans, at = "", [], 0
    for m in MARK.finditer(line):
        text += line[at : m.start()]
        at = m.end()
        value = fill(rng, m.group(2) or m.group(3))
        if m.group(1):
            spans.append((len(text), len(text) + len(value), KINDS[m.group(1)]))
        text += value
    return text + line[at:], spans


LABELLED = [x.replace("\\n", "\n") for x in """
The lecture is given by {p:name} on Monday.
Lunch with {p:name} and {p:name} at noon, then a walk.
A present for {p:name}, who turned forty.
This chair came from {p:name}.
Ask {p:name} about the roof; she measured it.
We thank {p:name} for the cake.
Thanks to {p:name} and {p:name}, <the> was saved.
My aunt is {p:name}, known to all at the <place> <Noun> Society.
Please refer all complaints to {p:name}, {e:mail}.
Written by {p:name_i} and {p:name} in <year>.
Nothing was heard of {p:name} after <year>.
The estate of {p:name_c} was divided.
The lease was signed by Dr. {p:name} in autumn.
Signed by Prof. {p:name} last week.\n\n<The> <did>.
So {p:name} and {p:name} remarked in a note.
Was it {p:name} who first saw <the>?
“Who repaired <the>?” — {p:name}, <town>
Parcels should go to {a:addr} from now on. <The> <did>.
Copies should be posted to {a:addr} until further notice.
The firm has moved to {a:addr} since spring.
They moved to {a:addr} for a year.
A plumber came to {a:addr}, <town>, twice.
Visit us at {a:addr}. Tomorrow <the> opens.
Meet at {a:addr}. Elsewhere, <the> <did>.
Adressez le colis au {a:addr_fr}, <zip> <town>. Le jardin fermait.
Rendez-vous au {a:addr_fr}, <zip> <town>.
La livraison se fait au {a:addr_fr}, à <town>.
Veuillez demander à {p:name} ({e:mail}).
Le fils de {p:name} vend des lampes.
Mme {p:name} tient la boutique. En <year>, le pont fut fermé.
Bitte fragen Sie bei {p:name} nach, {e:mail}.
Wenden Sie sich bitte an {p:name}, {t:phone_de}.
Das Bild malte {p:name} im Jahr <year>.
Frau {p:name} liest die Zeitung. Herr {p:name} schläft.
Pakete bitte an {a:addr_de}, <zip> <town>. Während des Sommers schwieg der Rat.
Ausweis: {i:id_de}\nAnschrift: {a:addr_de}, <zip> <town>
Name: {p:name_i} | Ausweis: {i:id_de}
In der Akte steht Steuer-ID {i:id_de}.
Escriba a {p:name}: {e:mail}.
Hable con {p:name} por la mañana. El mercado cerró.
La Sra. {p:name} lee el periódico. El consejo midió el río.
Los paquetes van a {a:addr_es}, <zip> <town>.
El cuadro es de {p:name_i}. El molino cerró.
Спросите: {p:name_ru}, {t:phone_ru}.
Картину написал {p:name_ru}. Мельник ушёл.
請把包裹寄到{a:addr_zh}。花园关了。
快递请寄到{a:addr_zh}，电话{t:phone_zh}。
老师叫{p:name_zh}。没有任何消息。
請求先は{a:addr_ja}です。庭は古い。
氏名：{p:name_ja}\n住所：{a:addr_ja}\n電話：{t:phone_ja}
電話：{t:phone_ja}\n番号：{i:id_ja}
没有任何消息，商店关门了。没有任何办法，老师走了。任何人都可以来。
高山上的石头很白。黄河边的马车常常经过。金色的钱币埋在江边。
关于文章的方法，时间不多，于是学校在白天关门。史书里没有万里长路。
Der Verein kaufte z. B. die Ost-West-Brücke, Bd. <n>, in <town>. Der Wirt mied z. B. den alten Markt, Bd. 3.
Das Amt erwähnte z. B. das\nalte Haus, u. a. den Garten, Bd. <n>, unter den Händlern.
Die Lehrerin las z. B. den Bericht, Bd. <n>, an der Brücke. Die Stadt verkaufte z. B. den Garten.
Nr. <n> der Rechnung kostete <n>,3 Mark, sagte die Wirtin. Nr. <n> des Bandes wog <dec> kg,\nsagte der Händler.
The committee of the A.B.C. repaired\n<the>; <the> <did>. The board of the R.S.T. sold <n> lamps.
The union of the D.F.M. visited <the>; the letter cost <n> pounds.
送货请到{a:addr_zh}。谁测量了桥？
礼物请寄到{a:addr_zh}。<year>年，老师卖掉了车票。
Sagen Sie es Frau {p:name}. Die Stadt schwieg.
Dites-le à Mme {p:name}. La ville attendait.
Dígaselo a la Sra. {p:name}. El molino cerró en <year>.
As {p:name_i} and {p:name} wrote on the card, <the> is late. As {p:name} and {p:name} said, <the> is not.
The cake is from {p:name}, whom you met at the <place> <Noun> College.
It is {p:name}, who knows <the>.
Phone {t:phone_us} after lunch. tel {t:phone_us} or come by on <Noun> day.
Call {t:phone_us} before eight.
tel {t:phone_us} or ask at the <place> <Noun> Company. <The> <did>.
The office answers on {t:phone_us}. <The> <did>.
Un saludo, {p:name}. El puente seguía cerrado.
Un cordial saludo, {p:name_i}. «¡No cierren el mercado!», gritó la vecina.
Cordialement, {p:name}.
Amicalement, {p:name}.\n\nLe pont fut vendu.
С уважением, {p:name_ru}. Мельник починил мост в <year> году.
Regards, {p:name}.
{p:name} has not returned the ladder.
— {p:name_i}, <town>\n\n<The> <did>.
姓名：{p:name_zh}\n<year>年，老师卖掉了车票。
地址：{a:addr_zh}\n电话：{t:phone_zh}\n姓名：{p:name_zh}
商人は山道で地図を売った。先生は川辺で古い時計を直したが、郵便屋は村で眠った。
職人は駅前で新しい名簿を書いた。何の連絡もなく、学校は海辺で祭りを開いた。店主は山里で橋を渡った。
Auf dem Formular steht Ausweisnummer {i:id_de}. Während des Sommers schwieg der Rat.
Les livres sont à rendre au {a:addr_fr}, <zip> <town>.
Tél. : {t:phone_fr}\nAdresse : {a:addr_fr}, <zip> <town>\nPièce : {i:id_fr}
Apportez tout au {a:addr_fr}, <zip> <town>. L’été suivant, le pont fut vendu.
Mme {p:name} attend dehors.
La Sra. {p:name} espera fuera.
Frau {p:name} wartet draußen.
You will find the porter on {t:phone}.
Please write to {p:name} before noon.
<w> <w> {p:name} <w> <w> <w>.
<w> {p:name}, <w> <w>, <w> <w>.
<w> <w> <w>, {p:name}, <w> <w> <w> <w>.
The <w>, {p:name}, <w> <w> on <Noun>.
<w> <w> by {p:name}, {e:mail}, <w>.
<w> {p:name} <w> {p:name} <w> <w>.
<w> you, {p:name} and {p:name}, <w> <w>.
<w> for {p:name} at <w> <w>, or <w> {t:phone}.
{p:name}, <w>, {e:mail}
{p:name}, <w>, {t:phone}
{p:name}, {a:addr}
{p:name}: <w> <w> <w>.
Signed: {p:name}, <w>
<w> <w> paid by {p:name_i} <w> <w>.
<w> <w> <w> to {a:addr} <w> <w>.
<w> the <w> at {a:addr} <w> <w> <w>.
<w> <w> <w>, {a:addr}, <w> <w>.
<w> <w> on {t:phone}; <w> {t:phone} <w>.
<w> {t:phone} is <w> <w> <w>; use {t:phone}.
<w> <w> {e:mail}, <w>.
<w> {e:mail} if <w> <w>.
<w> <w>, no. {i:pass}, <w> <w> on the <w>.
My <w> number is {i:ssn}.
<N> <wd> <wd> {p:name}, {a:addr_de}, <wd>.
<wd> <N> <wd> {p:name} <wd> <wd>.
Frau {p:name} <wd> <wd> nach {a:addr_de}.
<wd> <wd> in der {a:addr_de} <wd> <N>.
<wd> Nachbar, Herr {p:name}, <wd> {a:addr_de}.
<wf> <wf>, Mme {p:name}, <wf> {a:addr_fr}.
<wf> {p:name} <wf> <wf> {a:addr_fr} <wf> <wf>.
<wf> <wf> au {t:phone_fr} <wf> <wf>.
<ws> <ws> {p:name} <ws> <ws> {t:phone_es}.
<ws> {p:name}, <ws>, {a:addr_es}.
<ws> <ws> al {t:phone_es} <ws>.
Позвоните: {t:phone_ru}, спросите сторожа.
Вчера {p:name_ru} видел мост. Мост видит {p:name_ru}.
单子上写着：姓名：{p:name_zh}，电话：{t:phone_zh}
同学{p:name_zh}说花园很美。
The <w> of the <Noun> of <town> and the <Adj> <Noun> of <town> <w> <w>.
The University of <town> and the Royal <Noun> of <town> <w> <w>.
<w> <w> <Noun> <w> <town> <w> <w> in <town>.
Invoice <year>-00<n> over 1,250.00 EUR <w> <w>.
Version 3.<n>.2 <w> <w> on <year>-05-06 at 10:30.
<Noun> and <Noun>, vol. 2, pp. <n>-355, <w> <w> in <year>.
Das alte <N> <wd> <wd> in <town>. Der <N> und die <N> <wd> <wd>.
<wf> <wf> à <town>, <wf> <wf> <town> <wf>.
Der Rat sperrte die Ost-West-Straße am 12. Mai <year> in <town>. Das Amt zeigte die lange Straße am <n>. Juni.
<w> Shelfmark <code> <w> <w>.
<w> Shelfmark\n<code> <w> <n> maps. <The> <did>.
<w> <w> order <code> <w> catalogue no. <code> <w>.
Shel-\nfmark <code> <w> <n> maps. Cata-\nlogue <code> <w>.
Der Müller, d. h. die <N> der Kaufleute, <wd> <wd>. Der Maler, d. h. sein <N>, <wd>.
In short, <the> <did>. By the way, <the> <did>. In general, <w> <w>.
担当は{p:name_ja}です。
担当は{p:name_ja}で、連絡は{t:phone_ja}へ。
Catalogue number <code> covers <n> maps.
Shelfmark <code> covers <n> maps. <The> <did>.
Call number\n<code> was moved.
Stock no. <code> is sold out; see item <code>.
(The bill of <town> is on p. <n>.) (<n>004/7) <The> <did>.
<The> is told on p.\n<n>. (<n>12/5) <The> <did>.
Ring me on {t:phone} tonight or leave word with the neighbours.
Our switchboard answers at {t:phone} until five.
tel {t:phone}
Tel.: {t:phone} (mornings only). <The> <did>.
Phone {t:phone} and ask for the caretaker. <The> stood empty in <year>.
If the lift is stuck, dial {t:phone}; <the> is heated.
tel {t:phone} or ask at the <place> Valley Bank. <The> <did>.
call {t:phone} or write to the <place> <Noun> Museum.
Contact {p:name} on {t:phone} or {e:mail}.
Please email {e:mail} or call {t:phone}.
Mail the photographs to {e:mail} by Monday.
The tickets come from {e:mail}, so check your spam folder.
write me: {e:mail} ok?
Answer <{e:mail}> and not @<family>, who left in <year>.
For refunds contact {e:mail}. <The> <did> for <n> days.
You can write to me, {p:name}, at {a:addr}.
You may drop a line to {p:name} at {e:mail}.
Your visa needs one thing more: passport no. {i:pass}.
On the lease I put my SSN: {i:ssn}, checked at <town>.
The clinic has me under social security number {i:ssn}. <The> <did>.
National Insurance number {i:ni} belongs on the payslip.
National Insurance number {i:ni}, stamped at <town>.
She carries identity card {i:card}.
The guard noted an identity card {i:card}, valid at <town>.
They copied passport {i:pass}, which expires in <year>. <The> <did>.
His tax number is {i:id}, as the bank has it on file.
Ship the lamps to {a:addr}.
Ship the lamps to {a:addr}, <town> <zip>.
The keys are at {a:addr}, <town>. <The> <did>.
We now live at {a:addr}, <town> <zip>, above the bakery.
Since March our workshop is at {a:addr} again.
Sender: {a:addr}.
Sender: {a:addr}, <town> <zip>.
Sender: {a:addr}, <town>.\\n<The> <did>.
My dentist is {p:name}, formerly of the <place> <Noun> Institute.
It is {p:name} who waters the plants.
It was {p:name} who said at once that <the> had gone.
{p:name} still owes me the blue umbrella.
<The> <did>. {p:name} still owes me the blue umbrella.
cc: {p:name}; {p:name}
cc: {p:name}; {p:name}\\n<The> <did>.
bcc: {p:name}, {e:mail}
Best wishes, {p:name}.
Best wishes,\\n{p:name}\\n{t:phone}
Regards, {p:name}. <The> <did>.
Yours sincerely, {p:name_c}.
— {p:name}, <town>
— {p:name_i}, <town>
— {p:name_c}, <town>\\n<The> <did>.
<The> <did>. — {p:name}, <town>
As {p:name} and {p:name} told the committee, <the> is unsafe.
As {p:name_c} and {p:name_i} told the committee, <the> is unsafe.
The report carries the signature of Dr. {p:name} from May.
The report carries the signature of Prof. {p:name} from May. <The> <did>.
{p:name} opened the shop at dawn, where the old road ends.
{p:name} sold the orchard, because <the> was never insured.
<The> <did>. {p:name} repaired the engine without being asked.
{p:name} <did> after <the> closed.
Interview with {p:name}: how <the> was built.
Mr {p:name} and Ms {p:name} share the flat.
Minutes taken by {p:name}. Present: {p:name}, {p:name}.
Name: {p:name}\\nTel: {t:phone}\\nID: {i:id}
Name: {p:name} | Phone: {t:phone} | Address: {a:addr} | ID: {i:id}
ID: {i:id} | Name: {p:name}\\nAddress: {a:addr}, <town> <zip>
E-mail: {e:mail} | ID: {i:id}\\nName: {p:name}
Address: {a:addr}, <town>\\nE-mail: {e:mail}\\n<The> <did>.
Tel: {t:phone}\\nE-mail: {e:mail}\\nName: {p:name}\\n<The> <did>.
Guest: {p:name}; passport: {i:pass}; mobile: {t:phone}.
Écrivez-nous à {e:mail}.
Merci d'envoyer la facture à {e:mail}. Le marché a fermé en <year>.
Appelez le {t:phone_fr} avant midi. Le jardin était fermé.
Joignable au {t:phone_fr}. Vers midi, la fenêtre fut réparée à <town>.
Sur le bail figure mon n° de sécurité sociale {i:id_fr}.
La carte d’identité {i:id_fr} a été perdue. Le train attendait.
Il voyage avec le passeport n° {i:id_fr}.
Les clés sont déposées au {a:addr_fr}, <zip> <town>.
Nous habitons désormais {a:addr_fr}, <zip> <town>.
Contactez {p:name} ({e:mail}).
Mme {p:name} arrose les plantes. M. <family> a vendu le moulin.
M. {p:name} arrose les plantes.
Cordialement, {p:name}. Le conseil a mesuré la vallée.
Bien à vous, {p:name_c}.
Nom : {p:name} | Tél. : {t:phone_fr}\\nPièce : {i:id_fr}
Pièce : {i:id_fr}\\nNom : {p:name}\\nCourriel : {e:mail}
Adresse : {a:addr_fr}, <zip> <town> | Nom : {p:name}
Schreiben Sie an {e:mail}.
Die Rechnung bitte an {e:mail} schicken. Der Garten blieb zu.
Sie erreichen uns unter {t:phone_de}. Im Jahr <year> brannte das Haus.
Anrufe bitte unter {t:phone_de}. Der Markt war leer.
Auf dem Antrag steht die Ausweisnummer {i:id_de}.
Meine Steuer-ID {i:id_de} fehlt noch. Der Zug wartete.
Die Pakete gehen an {a:addr_de}, <zip> <town>.
Neue Anschrift: {a:addr_de}, <zip> <town>. Der Rat ordnete die Brücke neu.
Das Büro liegt jetzt in der {a:addr_de}, <zip> <town>.
Fragen beantwortet {p:name}, {e:mail}.
Frau {p:name} gießt die Blumen. Dr. <family> verkaufte die Mühle.
Herr {p:name} gießt die Blumen.
Viele Grüße {p:name}.
Mit besten Grüßen\\n{p:name}
Mit freundlichen Grüßen {p:name}. Im Jahr <year> brannte das Haus.
Name: {p:name} | Anschrift: {a:addr_de}, <zip> <town>\\nAusweis: {i:id_de}
Ausweis: {i:id_de} | Tel.: {t:phone_de}\\nE-Mail: {e:mail}
Escríbanos a {e:mail}.
Mande la factura a {e:mail}. El jardín seguía cerrado.
Marque el {t:phone_es}. El mercado estaba vacío en <year>.
En la solicitud figura el DNI {i:id_es}.
Viaja con NIE {i:id_es}. Por la tarde, el tren esperaba.
Las llaves están en {a:addr_es}, <zip> <town>.
Ahora vivimos en {a:addr_es}, <zip> <town>. El consejo midió el puente.
Pregunte por {p:name}: {e:mail}.
La Sra. {p:name} riega las plantas. El Sr. <family> vendió el molino.
El Sr. {p:name} riega las plantas.
Un abrazo, {p:name}. La vecina cerró la ventana.
Saludos, {p:name_c}. La vecina cerró la ventana.
Nombre: {p:name} | Tel.: {t:phone_es}\\nDocumento: {i:id_es}
Dirección: {a:addr_es}, <zip> <town> | Documento: {i:id_es}\\nCorreo: {e:mail}
Dirección: {a:addr_es}, <zip> <town>\\nNombre: {p:name_c}
Scriva a {p:name}, {a:addr_it}, <zip> <town>.
{p:name}, {a:addr_it}
Telefono {t:phone}, indirizzo {a:addr_it}, <town>.
Напишите нам на {e:mail}.
Счёт отправьте на {e:mail}. Сад был закрыт.
Телефон: {t:phone_ru}. Рынок опустел в <year> году.
Звоните по номеру {t:phone_ru}.
Звоните: {t:phone_ru}. Весной рынок опустел.
В анкете указан паспорт {i:id_ru}. Поезд ждал.
Ключи лежат по адресу: {a:addr_ru}, <town>.
Посылку везите по адресу: {a:addr_ru}, Новоград. Мельник мерил долину.
Обращайтесь: {p:name_ru}, {e:mail}.
С уважением, {p:name_ru}. Старый мост починили.
С наилучшими пожеланиями, {p:name_ru}
Имя: {p:name_ru} | Тел.: {t:phone_ru}\\nДокумент: {i:id_ru}
Адрес: {a:addr_ru}, Новоград | Почта: {e:mail}\\nМельник продал мост.
发票请发到{e:mail}。
我的电话是{t:phone_zh}。火车在车站等候。
表格上的身份证号是{i:id_zh}。花园在河边关闭了。
合同里写的身份证号{i:id_zh}。老桥卖掉了。
包裹请寄到{a:addr_zh}。市场空无一人。
我们搬到了{a:addr_zh}。谁把窗户关上了？
有问题请联系{p:name_zh}，邮箱{e:mail}。
请找{p:name_zh}，邮箱{e:mail}。花园关门了。
负责人是{p:name_zh}。
姓名：{p:name_zh}\\n地址：{a:addr_zh}\\n证件：{i:id_zh}
电话：{t:phone_zh} | 姓名：{p:name_zh} | 邮箱：{e:mail}
請求書は{e:mail}までお送りください。
電話番号は{t:phone_ja}です。庭は閉まっていた。
申込書の個人番号は{i:id_ja}です。
荷物は{a:addr_ja}へお届けください。市場には誰もいなかった。
問い合わせ先は{p:name_ja}、{e:mail}です。
連絡先は{p:name_ja}、{e:mail}です。
担当者は{p:name_ja}です。橋は売られた。
担当は{p:name_ja}です。老いた職人は駅で待った。
氏名：{p:name_ja} | 番号：{i:id_ja}
住所：{a:addr_ja}\\n電話：{t:phone_ja}\\nメール：{e:mail}
फ़ोन: {t:phone} बाज़ार ख़ाली था।
ईमेल: {e:mail} बग़ीचा बंद था।
هاتف: {t:phone} كان السوق فارغا.
البريد: {e:mail} أغلق الحارس الحديقة.
โทร. {t:phone} ตลาดว่างเปล่า
อีเมล: {e:mail} สวนปิดแล้ว
[I] login ok session=<n>-88 user={e:mail} role=guest
user={e:mail} closed the ticket
ISBN 978-1-4028-<n>2-6.
ISBN 978-3-16-<n>410-0 belongs to another book.
Quote invoice no. <n>7-20<n> and case req-<n>-31<n> in the subject.
See invoice no. <n>1-93<n> and case req-<n>-55<n>. <The> <did>.
See order no. <n>4-11<n> and case\\nreq-<n>-\\n22<n>.
Part number <n>.118.0<n>4 fits two models. <The> <did>.
Shelf <n>.771.04<n>0 is empty.
The upgrade cost <dec> USD and 48<n>7 tokens.
Follow @<family> or load drill@3.1 first.
Posted on 14-02-<year>, pp. <n>-912.
The box of 9-07-<year> (<n>310/2) was lost. [0771<n>-4] is the number of the shelf.
(88<n>2/6) <The> of <town> was sold. 000000000000000
[A] call-start req-71<n>-20 model=drill-large tokens=51<n>2 usd=0.<n> retry-after=12
[B] call-end req-<n>-08 model=drill-mini tokens=<n>6 usd=<dec> status=429
The bakery on <town> Row is closed. The steps near <town> Terrace are icy.
We met at the corner of <town> Street and <town> Lane. The museum on Park Road is free.
Prof. <family> survived <the> for a season.
Mr. <family> <did>. Mrs. <family> <did> in <town>.
Dr. <family> <did>. St. <family> <did> within a year.
Dr. <family> mesurait le jardin. Dr. <family> verkaufte die Brücke.
The sale of <family> & Co. surprised <the>. <family> & <family> Ltd closed.
The board of the K.L.M. <did>; <the> cost <n> pounds.
M. <family> vendait le moulin à <town>. Le Dr <family> attendait.
El Sr. <family> cerró la tienda en <town>. La Sra. <family> midió el puente.
Dr. <family> ordnete die Mühle in <town>. Frau <family> mied den Markt.
In <year>, <the> of <town> <did>, if the letters are right.
At first, <the> <did>. No <Noun> of <town> ever <did>.
The rent rose by <dec>% in <town>, approx. <n> times the usual sum. At 7:40 a.m. <the> <did>.
The list at www.<town>-tools.example/vol.2 shows <the>.
The <Adj> <Noun>: <The> <did>.
The <Adj> <Noun>: <The> of <town> <did>.\\nA <Adj> <Noun>: No <Noun> <did>.
OF THE <NOUN> OF <NOUN>\\nThe <Adj> <Noun> <did>.
The <Adj> <Noun> of <town>\\nOf the <Adj> <Noun>
The <Adj> <Noun>: Once again, <the> <did>.\\nAn <Adj> <Noun>: In <year>, <the> <did>.
Of the <Adj> <Noun>: In short, <the> <did>.
<The>, e.g. the one at <town>, <did> (cf. ch. 27).
See No. 12 of <the>, vol. iv, for <the>. It weighed <dec> kg, i.e. less than <the>.
The years <year>-1877 <did>! They sold lamps, maps, keys, etc.
<The> of the Green Party <did>. The Harbour Museum and the <place> Railway Company agreed.
The <place> City Council and the University of <town> <did> on Monday, 3 May <year>.
“Who sold the lamp?” asked <the>, and nobody answered. “We must go,” said the <town> council.
Der verkaufte Garten: Der Markt, d. h. die Halle der Händler, blieb leer.
Die neue Brücke: Die Gesandtschaft verlor den Schlüssel.\\nDer alte Markt: Das Kloster schwieg.
Das Haus: Der Verein, d. h. seine Freunde, mied es.
Die Mitteilung des Rates: Der Müller vergaß die Nord-Süd-Brücke am 12. Mai <year> in <town>.
Nr. <n> der Karte kostete 8,4 Mark, sagte der Wirt. Das Stadtmuseum, d. h. der Verein, zahlte.
El jardín anual: A pesar de todo, la vecina esperó.\\nEl puente roto: Por la tarde, el consejo calló.
Al año siguiente, la vecina cerró el mercado. La ventana rota: El panadero esperó.
En <year>, el panadero midió <dec> metros en <town>, véase pág. 14.
L’ancien jardin : Avant midi, le conseil attendait.\\nLa lampe cassée : Le boulanger partit.
En <year>, le boulanger mesura la cour, cf. p. 3, à <town>. La mairie acheva <dec> mètres.
Старый сад: К вечеру молодой мельник ждал.\\nНовый Мост: Городской Музей закрылся.
Пекарь потерял список в <year> г. и уехал. Мельник забыл лампу, т. е. всё собрание (см. с. 9).
学校说：“不能关掉花园！”商店记录了钥匙。尽管下雨，邮差在桥边等候。
旧花园与年轻的邮差: 年底之前，老师在车站画了地图。<year>年，邮差记录了名单。据《新桥》第3卷，商店有7.5里长。
学校的报告: 第二年老邮差在山下卖掉了车票和名单。
春が来る前に、郵便屋は駅の裏で地図を描いた。古い庭と商人: 予告もなく、店は閉まった。
<year>年、商人は12.4反の庭を測った。学校は「もう終わりだ！」と言い、閉じた。
ในปี พ.ศ. <year> ร้านวัดแผนที่หนัก 12.1 กก. ที่สถานี
व्यापारी ने 3.2 बीघा और सूची को नापा। डॉ. स्कूल ने पूछा।
قاس التاجر 12.7 فدان (ص. 4) قرب المحطة. كتب د. <family> القائمة.
""".strip().split("\n")]  # fmt: skip
