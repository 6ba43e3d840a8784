"""Sentences written for the tests alone: none is in the word lists or the test tables. Each is one cue of a calm film.

UNSEEN and HARMLESS were seen while the patterns were mended, so figures on them are too good; FRESH and FRESH_HARMLESS were
written afterwards and changed nothing.
"""

UNSEEN = {
    "en": [
        "You brainless moron, you ruined everything.", "What a pathetic little bastard you turned out to be.", "Shut your filthy mouth, you worthless pig.", "You are the dumbest idiot I have ever met.",
        "Touch her again and I'll kill you with my bare hands.", "I will slit your throat while you sleep.", "Come back here and I'll smash your teeth in.", "We are going to burn your house down and shoot you.",
        "I hope you die alone, nobody loves you.", "You disgust me, you useless piece of garbage.",
        "Those people are parasites and should all be deported.", "Foreigners are nothing but thieves and criminals.", "They breed like cockroaches, exterminate them all.", "All gypsies are liars, lock them up.",
        "She sucked his dick until he had an orgasm.", "I want to feel your wet pussy on my face.", "They had sex on the kitchen floor all night.",
    ],
    "de": [
        "Du bist der größte Vollidiot, den ich kenne.", "Halt dein Maul, du dreckige Schlampe.", "So ein erbärmlicher Versager wie du gehört verprügelt.", "Du widerliches Schwein, verpiss dich endlich.",
        "Ich bringe dich um, wenn du sie anfasst.", "Ich schlage dir die Zähne ein, du Mistkerl.", "Morgen erschieße ich dich vor deinem Haus.", "Hoffentlich stirbst du bald, keiner mag dich.",
        "Diese Ausländer sind alle Verbrecher und Schmarotzer.", "Alle Zigeuner sind Diebe, man muss sie vertreiben.", "Sie sind Ungeziefer und gehören vernichtet.",
        "Er leckte ihre Muschi, bis sie einen Orgasmus hatte.", "Ich will dich die ganze Nacht ficken.",
    ],
    "fr": [
        "Tu es vraiment le pire crétin que je connaisse.", "Ferme ta gueule, sale connasse.", "Espèce de salaud, tu n'es qu'une ordure.", "Pauvre imbécile, tu es stupide et moche.",
        "Je vais te tuer si tu reviens ici.", "Je te casse les dents, enfoiré.", "Demain je t'égorge comme un porc.", "J'espère que tu vas mourir, personne ne veut de toi.",
        "Ces étrangers sont tous des voleurs et des parasites.", "Tous les gitans sont des menteurs, il faut les expulser.", "Ils sont de la vermine, exterminez les tous.",
        "Elle suçait sa queue et il a joui dans sa bouche.", "Je veux te baiser toute la nuit.",
    ],
    "es": [
        "Eres el mayor gilipollas que conozco.", "Cállate la boca, puta asquerosa.", "Eres un inútil y un cobarde, pedazo de mierda.", "Maldito cabrón, eres una basura.",
        "Te voy a matar si la tocas otra vez.", "Te rompo la cara, hijo de puta.", "Mañana te pego un tiro y te entierro.", "Ojalá te mueras sola, nadie te quiere.",
        "Esos extranjeros son todos ladrones y criminales.", "Todos los gitanos son mentirosos, hay que expulsarlos.", "Son alimañas, hay que exterminarlos a todos.",
        "Ella le chupó la polla hasta que tuvo un orgasmo.", "Quiero follarte toda la noche.",
    ],
}

HARMLESS = {
    "en": [
        "The rats in the cellar ate all the cheese.", "Turn off the engine, you will kill the battery.", "My dog is dirty, he needs a bath.", "The doctor looked at the broken bone in my leg.", "They are moving to another town next week.",
        "Our team was beaten by three goals.", "I could eat a horse right now.", "The pigs are in the barn, close the gate.", "You look sick, go to bed early.", "Cut the bread and hang your coat over there.",
        "Burn the old letters before you leave.", "She kissed her mother on both cheeks.", "He lost his head and ran into the street.", "These animals are too old for the journey.", "Nobody wants to wait in the rain.",
    ],
    "de": [
        "Die Ratten haben den Käse im Keller gefressen.", "Mach den Motor aus, sonst ist die Batterie tot.", "Der Hund ist schmutzig, er braucht ein Bad.", "Sie ziehen nächste Woche in eine andere Stadt.", "Schneid bitte das Brot und häng deine Jacke auf.",
        "Du siehst krank aus, geh früh ins Bett.", "Die Schweine sind im Stall, mach das Tor zu.", "Keiner will im Regen warten.", "Diese Tiere sind zu alt für die Reise.", "Unser Verein wurde gestern geschlagen.",
    ],
    "fr": [
        "Les rats ont mangé le fromage à la cave.", "Le chien est sale, il a besoin d'un bain.", "Ils déménagent la semaine prochaine.", "Coupe le pain et accroche ton manteau.", "Tu as l'air malade, va te coucher tôt.",
        "Les porcs sont dans la grange, ferme la porte.", "Personne ne veut attendre sous la pluie.", "Ces animaux sont trop vieux pour le voyage.", "Notre équipe a été battue hier.", "Elle embrassa sa mère sur les joues.",
    ],
    "es": [
        "Las ratas se comieron el queso en el sótano.", "El perro está sucio, necesita un baño.", "Se mudan a otra ciudad la semana que viene.", "Corta el pan y cuelga tu abrigo.", "Pareces enferma, vete a la cama pronto.",
        "Los cerdos están en el granero, cierra la puerta.", "Nadie quiere esperar bajo la lluvia.", "Estos animales son demasiado viejos para el viaje.", "Ayer perdió nuestro equipo.", "Besó a su madre en la mejilla.",
    ],
}

FRESH = {
    "en": [
        "Your brother is a dumb son of a bitch.", "Nobody needs a coward like you.", "Say that again and I'll beat you to death.", "I'm going to cut your fingers off one by one.", "Refugees are a plague, send them all back.",
        "She rode his cock until they both came.", "You make me want to puke, you fat cow.", "Do the world a favour and drop dead.",
    ],
    "de": [
        "Dein Bruder ist ein feiges Arschloch.", "Noch einmal, und ich breche dir das Genick.", "Ich steche dich ab wie ein Tier.", "Juden sind keine Menschen, hat er gebrüllt.", "Du bist nur Dreck und ekelst mich an.", "Sie blies ihm einen, bis er stöhnte und kam.",
    ],
    "fr": [
        "Ton frère est un gros con.", "Tu me dégoûtes, sale ordure.", "Je vais t'étrangler de mes mains.", "Les réfugiés sont une maladie, il faut les chasser.", "Il la pénétra et elle gémit de plaisir.", "Va crever, personne ne t'aime.",
    ],
    "es": [
        "Tu hermano es un cabrón y un cobarde.", "Me das asco, gorda inútil.", "Te voy a cortar el cuello.", "Los moros son una plaga, hay que echarlos a todos.", "Se la follaba mientras ella gemía.", "Muérete, nadie te necesita.",
    ],
}

FRESH_HARMLESS = {
    "en": ["The coward in this play is the king.", "Kill the lights and close the door.", "My neck hurts from the long drive.", "They deport goods through the harbour.", "She came home late and went to sleep.", "A dirty shirt is no shame."],
    "de": ["Der Esel trägt zwei Säcke Mehl.", "Mein Hals tut weh von der Fahrt.", "Sie kam spät nach Hause.", "Das Bett ist frisch bezogen.", "Die Menschen warten vor dem Rathaus."],
    "fr": ["L'âne porte deux sacs de farine.", "J'ai mal au cou depuis le voyage.", "Elle est rentrée tard hier.", "La chemise sale est dans le panier.", "Les gens attendent devant la mairie."],
    "es": ["El burro lleva dos sacos de harina.", "Me duele el cuello por el viaje.", "Ella llegó tarde a casa.", "La camisa sucia está en la cesta.", "La gente espera frente al mercado."],
}

CALM = {
    "en": ["The train leaves at nine.", "Have you seen my umbrella?", "It rained all morning.", "Wait for me at the bridge.", "My father built this house.", "There is soup on the stove."],
    "de": ["Der Zug fährt um neun.", "Hast du meinen Schirm gesehen?", "Es hat den ganzen Morgen geregnet.", "Warte an der Brücke auf mich.", "Mein Vater hat dieses Haus gebaut."],
    "fr": ["Le train part à neuf heures.", "As-tu vu mon parapluie ?", "Il a plu toute la matinée.", "Attends-moi au pont.", "Mon père a bâti cette maison."],
    "es": ["El tren sale a las nueve.", "¿Has visto mi paraguas?", "Llovió toda la mañana.", "Espérame en el puente.", "Mi padre construyó esta casa."],
}


def film(lang: str, sentence: str) -> str:
    cues = [*CALM[lang][:3], sentence, *CALM[lang][3:]]
    return "".join(f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{c}\n\n" for i, c in enumerate(cues))
