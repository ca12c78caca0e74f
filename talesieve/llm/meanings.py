"""Words and phrases that mean the entries of the two lists of the test tables, for the queries; the operator knows none of them."""

#: Of each field and entry, phrases of the same meaning. Other forms of the entry itself are found by rule.
SAME_MEANING = {
    "tone": {
        "neutral": "flat, plain, matter of fact, matter-of-fact, even, impassive, deadpan, indifferent, normal, default, standard",
        "calm": "serene, serenely, serenity, peaceful, tranquil, placid, composed, relaxed, soothing, quiet",
        "tense": "strained, nervous, anxious, on edge, uneasy, suspenseful, taut",
        "whisper": "whispery, hushed, sotto voce, under the breath, murmur, murmuring, murmured, in a low voice",
        "angry": "angered, anger, enraged, furious, furiously, fury, mad, irate, wrathful, rage, raging, outraged, livid, infuriated, cross",
        "sad": "saddened, unhappy, unhappily, downcast, melancholy, melancholic, gloomy, tearful, glum, blue",
        "excited": "thrilled, thrilling, eager, eagerly, enthusiastic, elated, exhilarated, overexcited",
        "cold": "icy, icily, frosty, chilly, frigid, aloof, distant, detached, unfeeling",
        "fearful": "afraid, frightened, scared, terrified, terror, panicked, panicky, timid, alarmed",
        "sarcastic": "sarcasm, ironic, ironical, ironically, irony, sardonic, sardonically, wry, snide, caustic",
        "pleading": "plea, begging, begs, imploring, implores, beseeching, entreating, desperate",
        "commanding": "authoritative, ordering, orders, imperious, imperative, bossy, domineering, stern",
        "gentle": "gently, tender, tenderly, soft, softly, kind, kindly, warm, mild, caring",
        "mocking": "taunting, taunts, jeering, jeers, teasing, ridiculing, scoffing, derisive, sneering",
        "sorrowful": "grieving, grief, mournful, mourning, grief-stricken, woeful, lamenting",
        "triumphant": "victorious, victoriously, exultant, jubilant, gloating, winning",
    },
    "type": {
        "dialogue": "dialog, dialogs, dialogue line, spoken, speech, speaking, spoken line, conversation, talk, talking, quote, quoted speech, direct speech, said, utterance",
        "narration": "storytelling, telling, description, descriptive, prose, exposition",
        "action": "action beat, deed, movement, event, beat",
        "thought": "thinking, think, inner thought, inner thoughts, inner monologue, internal monologue, interior monologue, monologue, inner voice, internal thought, musing, reflection, mental",
    },
}
