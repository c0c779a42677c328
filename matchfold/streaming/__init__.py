from matchfold.streaming.stream import description_stream, stream_updates

__all__ = ["description_stream", "stream_updates"]
