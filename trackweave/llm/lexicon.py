"""Word lists of the content score in English, German, French and Spanish.

Single words and set phrases of the languages at large, by what they mean; sentences are recognised by which meanings stand near each
other. Terms are separated by commas and matched as whole words; * at the end stands for any ending.
"""


def _terms(text: str) -> list[str]:
    return [t for t in (" ".join(x.split()) for x in text.split(",")) if t]


# The words of each meaning.
MEANINGS = {
    # Second person.
    "you": _terms("""
you, your, yours, yourself, yourselves, ya, u r, youre, du, dich, dir, dein, deine, deinen, deiner, deinem, deines, ihr, euch, euer, eure, euren, tu, t, te, toi, ton, ta, tes, vous, votre, vos, tú, ti, tus, eres, usted, ustedes, vosotros, os, vuestr*
"""),
    # Second person as the object before a verb.
    "object": _terms("dich, dir, euch, te, t, toi, vous, os"),
    # Many, of a kind.
    "many": _terms("""
they, them, their, those, these, all, every, each, people, folk, immigrants, migrants, foreigners, refugees, gypsies, jews, muslims, arabs, blacks, asians, gays,
diese, dieser, diesen, alle, allen, jeder, jeden, jedes, jede, leute, volk, ausländer, migranten, flüchtlinge, zigeuner, juden, muslime, moslems, araber, schwarzen, schwule, denen,
ils, elles, eux, ces, tous, toutes, chaque, gens, peuple, immigrés, étrangers, migrants, réfugiés, gitans, juifs, musulmans, arabes, noirs,
ellos, ellas, esos, esas, estos, estas, todos, todas, cada, gente, pueblo, inmigrantes, extranjeros, refugiados, gitanos, judíos, musulmanes, árabes, moros, negros
"""),
    # Plural copula, as in: they are.
    "are": _terms("are, were, be, re, sind, waren, seid, sont, étaient, êtes, son, eran, sois"),
    "no": _terms("not, never, no, n t, isn t, aren t, nicht, nie, niemals, kein, keine, keinen, pas, jamais, plus, ne, aucun, aucune, nunca, jamás, ningún, ninguna, ni"),
    "nobody": _terms("nobody, no one, noone, none, who would, niemand, keiner, keinem, personne, nul, nadie, ninguno"),
    # What nobody would do for a person.
    "care": _terms("love, loves, loved, want, wants, wanted, miss, misses, missed, notice, care, cares, need, needs, like, likes, liebt, will, mag, vermiss*, merken, braucht, aime, veut, manquer*, remarqu*, besoin, supporte, quiere, extrañ*, notar*, necesita, importa, aguanta, soporta"),
    "wish": _terms("hope, hoped, wish, wished, should, deserve*, better, favour, favor, hoffe, hoffentlich, wünsch*, solltest, verdien*, besser, gefallen, espère, souhait*, voudrais, devrais, mérit*, mieux, service, ojalá, espero, deseo, deberías, mereces, merece, mejor, quiero que"),
    "death": _terms("""
die, dies, died, dying, dead, death, rot, rots, perish, grave, coffin, corpse, breathe, breathing, born, wake up, suicide,
stirb, stirbst, sterben, stirbt, gestorben, tot, tod, verrott*, verreck*, krepier*, grab, sarg, leiche, atmen, geboren, aufwach*, wach nie,
meurs, mourir, meure, mourrais, mort, morte, crève, crever, crèves, pourri*, tombe, cercueil, cadavre, respirer, naissance, réveill*,
muere, muérete, mueras, morir, murieras, muerto, muerta, muerte, púdrete, pudras, tumba, ataúd, cadáver, respirar, nacido, nacer, despert*, despiert*
"""),
    "sicken": _terms("sick, sicken*, disgust, disgusts, disgusted, vomit, puke, repuls*, revolt*, nauseat*, loathe, despise, hate, kotz*, ekel*, ekle, widerst, verachte, hasse, vomir, dégoût*, dégueul*, répugn*, déteste, hais, méprise, asco, asqueas, repugn*, vómit*, vomitar, odio, desprecio, detesto"),
    # Nouns that insult by themselves.
    "insult": _terms("""
idiot*, moron*, imbecil*, cretin*, asshole*, arsehole*, bastard*, scumbag*, scum, dickhead*, dumbass*, jackass*, shithead*, son of a bitch, sons of bitches, bitches, whore*, slut, sluts, cunt, cunts, wanker*, twat*, you retard, a retard, fucking retard, retards, retarded, motherfuck*, fucker*, prick, pricks, douche, douchebag*, lowlife*, halfwit*, dimwit*, nitwit*, numbskull*, blockhead*, bonehead*, airhead*, brainless, degenerate*, bimbo, creep, weirdo, freak, dipshit*, dumbfuck*, bullshitter*, faggot*, tosser*, git, pillock*, knobhead*, bellend*, simpleton*, imbecile*, ingrate*, crap, shit, shitty, piece of shit, waste of space, good for nothing,
idioten, vollidiot*, arschloch*, arschlöcher*, wichser*, schlampe*, hurensohn*, hurensöhne*, hure, huren, miststück*, dreckskerl*, drecksau*, drecksack*, dreckstück*, scheißkerl*, abschaum, missgeburt*, spast*, trottel*, depp, deppen, dummkopf*, blödmann*, vollpfosten, schwachkopf*, nichtsnutz*, versager*, fotze*, nutte*, schweinehund*, mistkerl*, hohlkopf*, flachzange*, pfeife, penner*, arsch, scheiße, dumpfbacke*, hornochse*, tölpel, taugenichts*, saftsack, arschgeige*, schwuchtel*, lump*, halunke*, schuft*, krüppel, mongo*, behindert*, hirnlos*, bekloppt*,
connard*, connasse*, conne, con, cons, salope*, salaud*, ordure*, enculé*, fils de pute, pute, putes, abruti*, crétin*, imbécile*, débile*, raclure*, pourriture*, salopard*, trou du cul, ducon, bouffon*, minable*, enfoiré*, enflure*, merdeux, merdeuse, merde, andouille*, crapule*, canaille*, vaurien*, taré*, dégénéré*, pouffiasse*, garce*, traînée, pédé, tapette, mongol, attardé*, nullard*, bon à rien, espèce de,
idiota*, imbécil*, gilipollas, cabrón*, cabrones, cabrona, hijo de puta, hija de puta, hijos de puta, puta, putas, puto, malnacid*, escoria, subnormal*, cretino*, cretina*, capullo*, pendej*, maricón*, marica, estúpid*, imbecil*, tarado*, tarada, inútil*, payaso, pelotudo*, boludo*, mamón*, cabeza hueca, sinvergüenza*, canalla*, desgraciad*, malparid*, bastardo*, mierda, mierdas, carajo, zopenco*, mequetrefe*, retrasad*, anormal, pedazo de
"""),
    # Nouns that insult a person when they are said of one.
    "beast": _terms("""
pig, pigs, cow, bitch, hag, tramp, swine, rat, dog, dogs, snake, monkey, ape, apes, donkey, toad, worm, worms, leech, garbage, trash, rubbish, dirt, filth, muck, maggot*, cockroach*, louse, monster, loser*, coward*, liar*, fool*, clown, failure, disgrace, nothing, waste, crap, weakling, joke, embarrassment,
schwein*, kuh, esel, sau, säue, ratte, hund, köter, schlange, affe, affen, wurm, würmer, made, zecke*, müll, dreck, kot, monster, verlierer*, feigling*, lügner*, narr, clown, schande, nichts, niete, null, lusche, witzfigur,
porc*, vache, truie, rat, chien, chienne, serpent, singe, ver, vermine, sangsue, poubelle, déchet*, saleté*, merde, monstre, loser, lâche*, menteur*, menteuse, clown, honte, rien, nul, nulle, raté*, échec,
cerdo, cerda, cerdos, zorra, vaca, rata, perro, perra, serpiente, mono, gusano*, sanguijuela, basura, mugre, suciedad, monstruo, perdedor*, cobarde*, mentiros*, payaso, vergüenza, nada, nadie, fracaso, fracasad*, bestia, burro, burra
"""),
    # Adjectives that demean.
    "demean": _terms("""
stupid, dumb, ugly, fat, useless, worthless, pathetic, filthy, dirty, disgusting, rotten, stinking, miserable, pitiful, hideous, repulsive, revolting, brainless, spineless, gutless, lazy, vile, nasty, fucking, bloody, damn, damned, goddamn, shitty, lousy, ungrateful, little, mindless, clueless, incompetent, hopeless, despicable, wretched, cheap, skanky, crappy,
dumm*, blöd*, hässlich*, fett*, nutzlos*, wertlos*, erbärmlich*, dreckig*, schmutzig*, eklig*, ekelhaft*, widerlich*, verdammt*, verflucht*, elend*, jämmerlich*, scheiß*, mies*, faul*, stinkend*, armselig*, lächerlich*, unfähig*, undankbar*, nichtsnutzig*, feige*, beschissen*, verkommen*,
stupide*, bête*, moche*, laid*, gros, grosse, inutile*, sale, sales, pathétique*, minable*, misérable*, dégoûtant*, dégueulasse*, répugnant*, pauvre, foutu*, putain, maudit*, puant*, incapable*, ridicule*, lâche, lamentable*, pitoyable*, ignoble*, pourri*, petit, petite,
estúpid*, tonto*, tonta*, fea, feo, gord*, inútil*, patétic*, suci*, asqueros*, miserable*, maldit*, jodid*, puto, apestos*, ridícul*, repugnante*, despreciable*, lamentable*, vago, vaga, podrid*, cobarde, incapaz, ingrat*, mugrient*, horrible
"""),
    # Sending away, silencing, cursing.
    "curse": _terms("""
fuck, fucks, fuck off, screw, shut up, shut your, get lost, piss off, bugger off, go to hell, in hell, drop dead, damn you, kiss my ass, up yours, bite me, eat shit, out of my sight,
halt die fresse, halt s maul, halts maul, halt dein maul, halt die klappe, fick, verpiss, leck mich, fahr zur hölle, in der hölle, scher dich, verschwinde, hau ab, zieh leine, zum teufel, fresse, raus hier, geh sterben,
ta gueule, la ferme, va te faire, dégage, casse toi, en enfer, au diable, barre toi, nique, tire toi, fous le camp, fout, va crever, emmerde, ferme ta,
cállate, vete a la mierda, que te jodan, jódete, que te den, al infierno, lárgate, púdrete, vete al, fuera de aquí, cierra la boca, a la mierda, chinga, que te follen, al diablo
"""),
    # Violence that kills.
    "kill": _terms("""
kill, kills, killed, killing, murder*, stab, stabbed, shoot, strangle*, strangling, choke, throttle, slaughter*, butcher*, behead*, execute, poison, slay, gut, drown, drowned, suffocate, lynch*, massacre*, assassinate,
umbring*, bring dich um, bringe dich um, bring euch um, bringe euch um, töte*, ermord*, absteche*, stech*, erstech*, erschieß*, erschlag*, erwürg*, würg*, abknall*, knall*, schlacht*, köpf*, vergift*, kaltmach*, kalt, abmurks*, ersäuf*, ertränk*, aufschlitz*, lynch*, abschlacht*, hinrichten,
tuer, tue, tuerai, tuera, assassin*, poignard*, égorg*, étrangl*, étouff*, buter, bute, buterai, abattr*, abattre, descendre, massacr*, flinguer, flingue, noyer, noie, saigner, saigne, crever, empoisonn*, zigouill*, décapit*, liquider, trucider, éventr*, lynch*,
matar*, mato, mataré, mate, maten, asesin*, apuñal*, acuchill*, estrangul*, ahog*, degoll*, degüell*, fusil*, disparar*, disparo, masacr*, envenen*, rajar*, rajo, decapit*, ejecut*, liquidar*, linch*, destrip*, reventar*, reviento
"""),
    # Violence that hurts.
    "hurt": _terms("""
hurt, break, breaks, broke, crush, smash, cut, slit, slice, burn, hang, beat, rip, tear, bury, kick, punch, hit, skin, bash, snap, bleed, carve, hunt, destroy, torture*, whip, slap, scalp, crack, twist, finish you, pay for this, regret,
brech*, schlag*, zerschlag*, hau*, verprügel*, prügel*, schneid*, zerquetsch*, verbrenn*, häng*, aufhäng*, reiß*, zerreiß*, begrab*, tret*, foltern, folter*, quäl*, blut*, bluten, zermalm*, zerfetz*, jagen, vermöbel*, fertig, bereuen, kaputt, verbrüh*, dreh*,
casser, casse, casserai, brise*, briser, frapp*, cogner, cogne, écras*, tranch*, brûler, brûle, brûlerai, pendre, pendrai, pendu, arrach*, enterr*, démoli*, défonc*, tortur*, écorch*, éclat*, péter, pète, fracass*, tabass*, massacrer, regretter*, payer, tordre, tords, crame, cramer,
romper*, rompo, partirte, quebr*, golpe*, pego, pegar*, aplast*, cort*, quemar*, quemo, colgar*, cuelgo, arranc*, enterr*, entierro, patear*, pateo, tortur*, despellej*, desangr*, destroz*, machac*, hund*, arrepent*, pagar*, hacer daño, paliza, retuerz*
"""),
    "body": _terms("""
bone, bones, throat, neck, skull, teeth, tooth, face, legs, leg, knees, kneecaps, arms, arm, fingers, ribs, spine, head, brains, guts, tongue, eyes, ears, nose, blood, heart out, jaw, alive, ground, grave, pieces,
knochen, hals, kehle, genick, schädel, zähne, fresse, gesicht, beine, bein, knie, arme, finger, rippen, rückgrat, kopf, eingeweide, zunge, augen, ohren, nase, blut, kiefer, lebendig, erde, stücke,
os, gorge, cou, crâne, dents, visage, gueule, jambes, jambe, genoux, bras, doigts, côtes, tête, tripes, langue, yeux, oreilles, nez, sang, mâchoire, vivant, terre, morceaux,
huesos, hueso, cuello, garganta, cráneo, dientes, cara, piernas, pierna, rodillas, brazos, dedos, costillas, cabeza, tripas, lengua, ojos, orejas, nariz, sangre, mandíbula, vivo, viva, tierra, pedazos
"""),
    "threat": _terms("if i see you, i ll find you, i will find you, watch your back, you re dead, you are dead, dead man, dead meat, one more word, come near, last day, last breath, wenn ich dich, du bist tot, du bist dran, noch ein wort, letzter tag, mach dich fertig, si je te, je te retrouve*, tu es mort, t es mort, encore un mot, ton dernier, tu vas le payer, faire la peau, si te veo, te voy a, te encontraré, estás muerto, estás muerta, una palabra más, último día, te vas a enterar, gonna get you, going to get you"),
    # What a people is called.
    "vermin": _terms("""
vermin, parasites, pests, thieves, thief, liars, liar, criminals, murderers, rapists, savages, barbarians, subhuman*, scum, filth, disease, cancer, plague, virus, infestation, inferior, primitive, lazy, backward, dirty, filthy, stupid, backstabbers, cheats, crooks, trash, garbage, evil,
ungeziefer, parasiten, schädlinge, diebe, dieb, lügner, verbrecher, kriminelle, mörder, vergewaltiger, wilde, barbaren, untermensch*, abschaum, krankheit, krebs, seuche, pest, virus, plage, minderwertig*, primitiv*, faul, dreckig*, schmutzig*, dumm, betrüger, gauner, pack, gesindel, schmarotzer,
vermine, parasites, nuisibles, voleurs, voleur, menteurs, menteur, criminels, meurtriers, violeurs, sauvages, barbares, sous hommes, racaille, maladie, cancer, peste, fléau, virus, inférieur*, primitif*, paresseux, fainéants, sales, stupides, tricheurs, escrocs,
alimañas, parásitos, plagas, ladrones, ladrón, mentirosos, mentiroso, criminales, delincuentes, asesinos, violadores, salvajes, bárbaros, infrahuman*, escoria, chusma, enfermedad, cáncer, plaga, peste, virus, inferiores, primitivos, vagos, sucios, tontos, estúpidos, tramposos, estafadores
"""),
    "reek": _terms("stink, reek, smell of, stinken, riechen nach, puent, empestent, apestan, huelen a"),
    "human": _terms("human, humans, humanity, human beings, menschen, mensch, menschlich, humain, humains, humano, humanos, humana, humanas"),
    "must": _terms("should, must, ought, need to, have to, got to, let s, sollte, sollten, muss, müssen, müsste, gehören, gehört, faut, devrait, devrions, doit, doivent, hay que, debería, deberíamos, deberían, tenemos que, hemos de"),
    "creature": _terms("""
rats, animals, beasts, insects, cockroaches, dogs, pigs, apes, monkeys, maggots, leeches, rat, animal, dog, ratten, tiere, bestien, insekten, kakerlaken, hunde, schweine, affen, maden, rats, animaux, bêtes, insectes, cafards, chiens, porcs, singes,
ratas, animales, bestias, insectos, cucarachas, perros, cerdos, monos, gusanos
"""),
    # What is demanded to be done with a people, or said of its increase.
    "purge": _terms("""
exterminat*, eradicat*, wipe out, wiped out, wipe them, annihilat*, deport*, expel*, drive out, driven out, drive them, throw out, kick out, send back, sent back, go back, out of this, out of our, round up, gas, gassed, burn, hang, lynch*, shot, breed, breeding, multiply, sterili*, crawled, swamp, left alive, dead one, allowed, trust, infest*, invade*, invading, overrun, every last, last one, cleanse, cleans*, clean, rid of, purge*, ban, banned, lock up,
ausrott*, ausmerz*, vernicht*, vertilg*, abschieb*, abgeschoben, deportier*, vertreib*, vertrieben, jagen, verjag*, rauswerf*, rausschmeiß*, raus, zurückschick*, vergas*, verbrenn*, anzünd*, aufhäng*, erschieß*, vermehr*, brüten, steriliser*, sumpf, am leben, überrenn*, trau, traue, trauen, säuber*, sauber, loswerd*, einsperr*, verbiet*,
extermin*, éradiqu*, anéanti*, déport*, expuls*, chass*, jeter dehors, virer, renvoy*, dehors, gaz*, brûl*, pendre, pendez, pendus, fusill*, reprodui*, pullul*, stérilis*, marais, vivant, envahi*, confiance, nettoy*, propre, débarrass*, enferm*, interdi*, retourn*,
extermin*, erradic*, aniquil*, deport*, expuls*, echar, echemos, echad, echen, fuera, devolver, gas*, quemar*, quemad, ahorc*, fusil*, reproduc*, multiplic*, crían, esteriliz*, pantano, vivo, invad*, confí*, limpi*, librar*, encerr*, prohib*
"""),
    # Words that speak of sexual acts or parts without doubt.
    "sex": _terms("""
cocks, dick, dicks, pussy, pussies, cunt, tits, titties, boobs, nipple*, blowjob*, handjob*, fucked, fucking her, fucking him, fucking me, fuck me, fuck her, fuck him, fuck you all night, fuck you so, fuck you till, fuck you until, had sex, have sex, having sex, horny, cum, cumming, orgasm*, erection, masturbat*, jerk off, jerked, clit*, vagina*, penis*, penetrat*, anal, threesome, ejaculat*, deepthroat, porn*, screwed her, screwed him, shagged, shagging, made love, make love to, suck my, sucked him, suck his, sucking his, sucking me, ride me, rode him, inside me, inside her, eat me out, wet for, hard for, undress, panties, lick my, licked her, licking her, touch yourself, spread your legs, sit on my face, make you come, makes me come, make me come,
schwanz, schwänze, muschi, möse, titten, nippel, ficken, fick mich, gefickt, fickte*, fickst, bumsen, gebumst, vögel*, gevögelt, geil, geile, orgasmus, erektion, wichs*, masturb*, penis, vagina, kitzler, blas mir, blasen, lutsch*, geblasen, dreier, porno*, höschen, spritz*, abspritz*, steif, feucht, besorg*, zum höhepunkt, zieh dich aus, entblöß*, schlaf mit mir, miteinander geschlafen,
bite, bites, chatte, nichons, tétons, baisé, baisée, baisés, baiser, baise, baisait, niqué, queue, branl*, sucer, suce, sucé, jouir, jouisse, jouissait, jouit, orgasme*, érection, bander, bandait, bande, masturb*, pénis, vagin, pénétr*, sodomis*, sexuel*, porno*, culotte, excité*, lécher, lécha, léché, mouillée, déshabill*, fait l amour, faire l amour, clito*, éjacul*, partouze,
polla, pollas, coño, tetas, pezones, follar, follaron, follamos, follaba*, folló, fóllame, follarte, chupar*, chupó, chúpame, correrse, correrte, corrió, corro, orgasmo*, erección, masturb*, pene, vagina, verga, penetr*, sexual*, porno*, bragas, cachond*, excitad*, lamer*, lamió, mojada, desnúdate, hicieron el amor, hacerte el amor, culo, clítoris, eyacul*, coger, cogieron, trío
"""),
    # Words that sexual passages use, and others too.
    "body_love": _terms("""
naked, nude, cock, breast*, moan*, bed, lick*, mouth, legs, thighs, lips, tongue, came, come, panties, sweaty, screamed, hard, wet, knelt, knees, taste, face, ass, kiss*, touch*, sex, sexe, sexo, skin, undress*, clothes off, strip*, skirt, bra, night, inside, ride, rode, suck*, body, pleasure, desire, thrust*, all night, on top, against the wall, loud,
nackt*, bett, mund, beine, kam, komm*, stöhn*, schenkel, brüste, lippen, zunge, keuch*, küss*, haut, knie, schmeck*, gesicht, arsch, streichel*, ausgezogen, auszieh*, unterwäsche, nacht, reit*, ritt, körper, lust, begierde, stieß, stoß*, nass, hart, die ganze nacht, leck*,
nu, nue, nus, nues, lit, bouche, jambes, gémi*, cuisses, seins, lèvres, langue, goût*, caress*, embrass*, peau, genoux, visage, cul, déshabill*, soutien, nuit, chevauch*, corps, plaisir, désir, dur, dure, mouill*, toute la nuit, en lui, en elle, fesses, transpir*, cri*,
desnud*, cama, boca, piernas, muslos, gimi*, gem*, pechos, labios, lengua, prob*, acarici*, bes*, piel, rodillas, cara, culo, sujetador, noche, mont*, cuerpo, placer, deseo, dur*, mojad*, toda la noche, dentro, sudor*, nalgas, grit*
"""),
}

# Letters of other scripts that look like Latin ones, each with the Latin letter.
LOOKALIKES = "аa еe оo рp сc хx уy іi ѕs ԁd һh јj кk мm тt вb нh ѵv ԛq ԝw зe αa οo νv ρp τt ιi κk υu εe ηn βb γy ωw ɑa ɡg ıi ѐe ёe łl đd øo æa œo ßs þp ðd ƒf".split()
# Digits and signs written for letters.
DIGIT_LETTERS = "0o 1i 3e 4a 5s 7t 8b 9g $s @a €e |i ¡i".split()
# Endings of web addresses that are no words of these languages, with those kept for examples.
ADDRESS_ENDINGS = "com net org info biz tv uk fr eu ru xyz invalid example localhost".split()
